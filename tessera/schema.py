"""The tables' schemas."""

from __future__ import annotations

SYMBOL = "struct<name:string,kind:string,line_start:int,line_end:int,language:string,signature:string>"
CHUNK = (
    "chunk_id string, content string, file_path string, repo_name string, language string, component_name string, start_line int, end_line int, chunk_type string, "
    f"symbols array<{SYMBOL}>, metadata map<string,string>, dependencies array<string>, required_interfaces array<string>, service_name string, mds_class string, ord int"
)
EXPECTED = "struct<repo_name:string,file_path:string,relevance:int>"
CASE = f"id string, query string, category string, query_type string, expected_files array<{EXPECTED}>, expected_symbols array<string>, expected_repos array<string>, difficulty string, description string"
FILE = "repo_name string, file_path string, content string"
