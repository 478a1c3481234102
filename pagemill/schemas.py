"""The record types of the engine, as Spark schemas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

PART = "struct<kind:string,text:string,tex:string,target:string>"
BLOCK = f"struct<id:string,kind:string,parts:array<{PART}>,tex:string,rows:array<array<string>>,target:string>"
PART_ARROW = pa.struct([(n, pa.string()) for n in ("kind", "text", "tex", "target")])
BLOCK_ARROW = pa.struct([("id", pa.string()), ("kind", pa.string()), ("parts", pa.list_(PART_ARROW)), ("tex", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("target", pa.string())])
PAGE = f"id string, doc_id string, page_index int, subject string, blocks array<{BLOCK}>, target_text string, has_math boolean, has_table boolean, flags int"
COMPACT = "i string, t string, s string, f int"
TASK = "struct<task_type:string,prefix_text:string,visual_text:string,suffix_text:string,target_text:string,is_text_only:boolean>"
CANVAS = "struct<width:int,height:int,grid_w:int,grid_h:int,visual_tokens:int,overflow:boolean>"
CHAT = "messages array<struct<role:string,content:string>>, images array<string>"


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
