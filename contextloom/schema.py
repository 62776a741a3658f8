"""Schemas of the tables that the operators pass on."""

from __future__ import annotations

FILE = "path string, content string, size long, modified_time timestamp, encoding string"
LISTING = "path string, size long, modified_time timestamp, extension string"
#: One nullable superset of what the chunkers tell about a chunk: its fields can be pruned and compared.
META = (
    "struct<file_path:string,start_line:int,end_line:int,chunk_type:string,language:string,function_name:string,"
    "is_async:boolean,args:array<string>,docstring:string,class_name:string,base_classes:array<string>,"
    "methods:array<string>,import_type:string,modules:array<string>,module:string,names:array<string>,name:string,"
    "block_type:string,heading:string,heading_level:int,has_code:boolean,code_languages:array<string>,word_count:int>"
)
CHUNK = f"path string, idx int, text string, meta {META}, error string"
INDEX = f"id long, embedding array<float>, text string, meta {META}, chunk_id string, source string, added_at timestamp"
HIT = "query_id long, id long, score double, rank int"
AGENT = "agent_id long, capabilities array<string>, status string, current_tasks int, max_concurrent_tasks int, last_heartbeat timestamp, registered_at timestamp"
TASK = "task_id long, priority int, status string, created_at timestamp, started_at timestamp, completed_at timestamp, assigned_agent long, required_capabilities array<string>"
