"""Stable identifiers: shortened SHA-256 digests over parts joined by the unit separator."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SEPARATOR = "\x1f"
DIGEST_CHARS, SPACE_CHARS = 24, 32


def _parts(parts: tuple[Column | str, ...]) -> list[Column]:
    # concat_ws skips nulls, which would let ("a", null) meet ("a",): nulls count as empty
    return [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]


def digest(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *_parts(parts)), 256), 1, DIGEST_CHARS)


def conversation_id(source: Column | str, external_id: Column | str) -> Column:
    return F.concat(F.lit("conv_"), digest(source, external_id))


def message_id(conversation: Column | str, external_id: Column | str) -> Column:
    return F.concat(F.lit("msg_"), digest(conversation, external_id))


def chunk_id(message: Column | str, order: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("chunk_"), digest(message, order, text))


def entity_id(key: Column | str) -> Column:
    return F.concat(F.lit("ent_"), digest(key))


def topic_id(members_hash: Column | str) -> Column:
    return F.concat(F.lit("topic_"), digest(members_hash))


def fact_id(subject_key: Column | str, statement_key: Column | str) -> Column:
    return F.concat(F.lit("fact_"), digest(subject_key, statement_key))


def text_hash(text: Column | str) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


def space_id(token: Column | str) -> Column:
    return F.substring(text_hash(token), 1, SPACE_CHARS)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_hash_of(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@F.pandas_udf(StringType())
def content_hash(value: pd.Series) -> pd.Series:
    """SHA-256 of canonical JSON, of JSON texts: to_json orders, escapes and drops nulls otherwise."""
    return value.map(lambda x: None if x is None else content_hash_of(json.loads(x)), na_action="ignore")


@F.pandas_udf(StringType())
def keys_hash(values: pd.Series) -> pd.Series:
    """Content hash of an array of strings, sorted."""
    return values.map(lambda x: None if x is None else content_hash_of(sorted(x)))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """Content hash of a sorted pair."""
    return keys_hash(F.array(*_parts((a, b))))
