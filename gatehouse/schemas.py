"""Explicit schemas of all tables."""

from pyspark.sql import types as T

_IDS = T.ArrayType(T.StringType(), False)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

#: What a source yields: one row per document.
RAW = _struct(("document_id", S, False), ("connector", S, False), ("uri", S, False), ("title", S, False), ("version", S, True), ("grants", _IDS, False), ("denies", _IDS, False), ("text", S, False))
DOCUMENTS = _struct(("document_id", S, False), ("connector", S, False), ("uri", S, False), ("title", S, False), ("version", S, True), ("content_hash", S, False), ("fingerprint", S, False), ("grants", _IDS, False), ("denies", _IDS, False), ("text", S, False))
CHUNKS = _struct(("chunk_id", S, False), ("document_id", S, False), ("ordinal", I, False), ("span_start", I, False), ("span_end", I, False), ("text", S, False), ("grants", _IDS, False), ("denies", _IDS, False))
#: The index holds no text.
INDEX = _struct(("chunk_id", S, False), ("document_id", S, False), ("policy_id", L, False), ("bin", T.ArrayType(L, False), False), ("i8", T.ArrayType(T.ByteType(), False), False))
POLICIES = _struct(("policy_id", L, False), ("policy_key", S, False), ("grants", _IDS, False), ("denies", _IDS, False))
QUANT = _struct(("minimum", T.ArrayType(T.DoubleType(), False), False), ("scale", T.ArrayType(T.DoubleType(), False), False), ("dimension", I, False))
EDGES = _struct(("child", S, False), ("parent", S, False))
RESULT = _struct(("rank", I, False), ("chunk_id", S, False), ("document_id", S, False), ("text", S, False), ("score", T.DoubleType(), True), ("connector", S, True), ("uri", S, True), ("title", S, True), ("version", S, True), ("span_start", I, False), ("span_end", I, False))
