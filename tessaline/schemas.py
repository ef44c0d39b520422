"""Schemas of the operation logs that all views are derived from."""

KV_LOG = "table string, key string, op string, seq bigint, payload binary, encrypted boolean, ts timestamp"
INC_LOG = "table string, key string, seq bigint, op string, pos bigint, count_from string, entry_key string, payload binary"
INC_META = "table string, key string, entry_size bigint"
SQL_TABLES = "table_name string, columns array<struct<name:string,type:string,isPrimaryKey:boolean,default:string,maxByteSize:bigint>>"

SAVE, FREE = "S", "D"
ADD, INSERT, OVERWRITE, SKIP, UNKEY, DROP = "add", "insert", "overwrite", "skip", "unkey", "drop"
TOP, BOTTOM = "top", "bottom"
