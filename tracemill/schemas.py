"""Canonical tables.  A location is three flat columns (file, line, col); file null = none."""

from __future__ import annotations

EVENT_FIELDS = ["type", "severity", "code", "message", "file", "line", "col"]

#: struct produced by every extraction tier
EVENT_STRUCT = (
    "struct<type:string,severity:string,code:string,message:string,"
    "file:string,line:bigint,col:bigint>"
)

TERMINAL = ["completed", "failed", "killed", "timeout"]
STATUSES = ["running", *TERMINAL]

TASK_JSON = """
  task_id string, command string, cwd string, status string, exit_code int, pid bigint,
  parser_name string, started_at string, finished_at string, duration_ms bigint,
  events_count bigint, error_count bigint, purpose string, carrier string,
  raw_output string, dedup_collapsed bigint,
  metrics struct<raw_output_bytes:bigint, structured_events_bytes:bigint,
    visible_events:bigint, skipped_noise_events:bigint, locations_extracted:bigint,
    codes_extracted:bigint, pairs_merged:bigint>
"""

EVENT_JSON = """
  seq bigint, type string, severity string, code string, message string,
  location struct<file:string, line:bigint, column:bigint>,
  context struct<before:array<string>, line:string, after:array<string>>
"""

PARSER_DIM = """
  name string, detect array<string>, detect_full array<string>, parser_type string,
  route string, priority int, min_version string, max_version string, source string
"""

RULE_DIM = """
  parser string, ord int, name string, regex string, event_type string, severity string,
  fields map<string,int>, state_condition string, state_transition string,
  deprecated boolean, replaced_by string
"""

CODE_REF_DIM = "tool string, code string, message string, source string"

AGENT_JSON = """
  type string, message string,
  item struct<type:string, server:string, tool:string, command:string, cmd:string,
    arguments:string, exit_code:int, text:string>,
  usage struct<input_tokens:bigint, output_tokens:bigint, cached_input_tokens:bigint>
"""
