"""Word lists of query understanding; small, and broadcast as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Chinese terms and the English words that a query is widened by.
ZH_EN = {
    "传感器": "sensor", "电源": "power", "风扇": "fan", "温度": "temperature", "电压": "voltage", "内存": "memory", "硬盘": "disk", "板卡": "board", "总线": "bus",
    "阈值": "threshold", "日志": "sel log", "事件": "event", "热插拔": "hotplug", "上电": "power on", "下电": "power off", "接口": "interface", "数据": "data", "模型": "model",
    "配置": "config", "服务": "service", "管理": "management mgmt", "监控": "monitor monitoring", "升级": "upgrade", "扫描": "scan detect", "启动": "startup init",
    "初始化": "initialize init", "依赖": "dependency dep", "关系": "relation", "完整": "full complete", "路径": "path", "链路": "link", "联动": "interaction", "传递": "transfer",
    "流转": "flow", "触发": "trigger", "控制": "control ctrl", "设备": "device dev", "组件": "component", "定义": "definition def", "命令": "command cmd", "数据流": "dataflow",
    "对象": "object obj", "应用": "application app", "入口": "entry", "导出": "export dump", "信息": "info", "读取": "read", "写入": "write", "收发": "send receive", "告警": "alert",
    "实现": "implementation impl", "电容": "capacitor", "电路": "circuit", "可更换": "fru replaceable", "固件": "firmware", "版本": "version", "传感": "sensing", "状态": "status", "协议": "protocol",
}

# Abbreviations.
ABBREVIATIONS = {
    "mgmt": "management", "mgr": "manager", "ctrl": "control", "dev": "device", "cfg": "config", "svc": "service", "obj": "object", "impl": "implementation", "dep": "dependency", "cmd": "command", "app": "application",
}

# English terms that a query is widened by in Chinese.
EN_ZH = {
    "sensor": "传感器", "power": "电源", "threshold": "阈值", "sel": "日志", "event": "事件", "hotplug": "热插拔", "frudata": "FRU数据", "fructrl": "FRU控制", "ipmi": "IPMI", "pcie": "PCIe", "bios": "BIOS",
}

# Words that say which language or kind of chunk is meant; of several the last one counts.
LANGUAGE_WORDS = {"lua": ["lua", "luajit"], "c": ["c语言", "c code"], "cpp": ["c++", "cpp"], "python": ["python", "py"], "json": ["json", "mds", "csr", "ipmi", "sr"]}
TYPE_WORDS = {
    "function": ["函数", "function", "方法", "method"], "class": ["类", "class", "class定义"], "mds_model": ["模型", "model", "mds模型"],
    "mds_ipmi_cmd": ["ipmi命令", "ipmi command", "ipmi"], "csr_object": ["csr", "设备对象", "device object"], "doc_section": ["文档", "document", "文档说明"],
}

# Terms that misspelt words are held against.
DOMAIN_TERMS = [
    "sensor", "sensors", "threshold", "config", "monitoring", "management", "alert", "event", "logging", "function", "init", "initialize", "startup",
    "power", "control", "ipmi", "ipmb", "protocol", "command", "fru", "frudata", "fructrl", "devmon", "device", "vpd", "bios", "pcie", "mdb", "bus",
    "i2c", "libipmi", "sel", "reading", "service", "model", "application", "handler", "callback", "register", "subscribe", "publish", "interface",
    "dependency", "dependencies", "component", "object", "instance", "discrete", "metric", "voltage", "temperature", "firmware", "upgrade",
    "capacitor", "circuit", "payload", "restore", "timeout", "flag", "chassis", "state", "machine", "executor", "format", "policy", "wrapper",
    "channel", "driver", "adapter", "message", "filter", "manager", "root", "discovery",
]

# Words that are no keywords.
STOP_WORDS = [
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "how", "what", "where", "when", "which", "who", "why", "do", "does", "did", "can",
    "could", "should", "would",
]


def pairs(spark: SparkSession, table: dict[str, str], key: str, value: str) -> DataFrame:
    return spark.createDataFrame(list(table.items()), f"{key} string, {value} string")
