"""Settings of the engine; the defaults are those of the system whose results it matches."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SearchConfig:
    rrf_k: int = 60
    default_top_k: int = 10
    max_top_k: int = 50
    bm25_weight: float = 0.5
    dense_weight: float = 0.5
    code_shift: float = 0.15
    weight_floor: float = 0.1
    max_per_file: int = 3
    rerank_alpha: float = 0.6
    #: Candidates of a query that an outer reranker sees, and results of it that count.
    rerank_most: int = 500
    rerank_top: int = 20
    inject_rows: int = 3
    inject_dense_at: int = 5
    inject_sparse_at: int = 10
    #: Whether filters bind the dense path only (as in the original) or all paths.
    filter_scope: str = "all"

    def clamp(self, top_k: int | None) -> int:
        """The number of results to return: the default if none is asked for, never above the maximum."""
        return min(top_k or self.default_top_k, self.max_top_k)


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    #: Whether documents without a matching token may fill up a result list.
    pad_zero: bool = False


@dataclass(frozen=True)
class GraphConfig:
    max_hops: int = 2
    decay: float = 0.5
    prune: float = 0.05
    top_k: int = 30
    #: Whether a later edge between two nodes replaces an earlier one of another type.
    single_edge: bool = False


@dataclass(frozen=True)
class IngestConfig:
    # Languages by extension, and folders to leave out.
    extensions: dict[str, str] = field(default_factory=lambda: {
        ".lua": "lua", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".py": "python", ".json": "json", ".md": "markdown",
    })
    disabled: tuple[str, ...] = ("python",)
    exclude: tuple[str, ...] = ("build/", "gen/", ".git/", "test/", "tests/", "dt_test/", "third_party/", "images/", "node_modules/", ".vitepress/", "deploy/", "scripts/")
    window_lines: int = 150
    overlap: int = 5
    min_chars: int = 30


@dataclass(frozen=True)
class EngineConfig:
    search: SearchConfig = SearchConfig()
    bm25: Bm25Config = Bm25Config()
    graph: GraphConfig = GraphConfig()
    ingest: IngestConfig = field(default_factory=IngestConfig)

    @staticmethod
    def read(path: str) -> EngineConfig:
        """The settings of a file, section by section; defaults for what it doesn't say, and for all of it if there is no file."""
        from tessera.sources.files import read_data

        try:
            data = read_data(path) or {}
        except FileNotFoundError:
            return EngineConfig()
        kinds = {"search": SearchConfig, "bm25": Bm25Config, "graph": GraphConfig, "ingest": IngestConfig}
        if unknown := set(data) - set(kinds):
            raise ValueError(f"no section is named {sorted(unknown)}")
        listed = lambda v: tuple(v) if isinstance(v, list) else v
        return EngineConfig(**{k: kind(**{name: listed(v) for name, v in (data.get(k) or {}).items()}) for k, kind in kinds.items()})
