"""Duplicates hidden by formatting: bottom-up hashing of nested records.

A record is a tree: text and flag leaves, ordered nodes (lists) and unordered ones
(objects). Leaves are normalised and hashed, an unordered node hashes the sorted digests of
its named children, so the order of fields is lost and nothing else. Records are grouped by
the digest of their root; the canonical form travels along as second key, so that a group
holds only records that agree in full, even if two digests should collide.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import squeezed

# How a flag says yes.
TRUE_WORDS = frozenset({"true", "t", "yes", "y", "1"})


def flag(value: object) -> bool:
    """A flag as boolean: null and anything but a yes is false."""
    if isinstance(value, str):
        return value.strip().lower() in TRUE_WORDS
    return bool(value)


def leaf(value: object) -> bytes:
    """Canonical bytes of a leaf; null and text without letters and digits agree."""
    if isinstance(value, bool):
        return b"b1" if value else b"b0"
    if isinstance(value, (int, float)):
        return b"n" + repr(value).encode()
    return b"s" + squeezed(value if isinstance(value, str) else None).encode()


def canonical(node: object) -> tuple[bytes, bytes]:
    """(digest, canonical form) of a tree of dicts (unordered), lists (ordered) and leaves."""
    if isinstance(node, dict):
        parts = []
        for name, child in node.items():
            digest, form = canonical(child)
            label = str(name).encode()
            parts.append((hashlib.blake2b(label + b"\0" + digest, digest_size=16).digest(), label + b"\0" + form))
        parts.sort()
        body = b"{" + b"\1".join(form for _, form in parts) + b"}"
        return hashlib.blake2b(b"{" + b"".join(d for d, _ in parts), digest_size=16).digest(), body
    if isinstance(node, (list, tuple)):
        parts = [canonical(child) for child in node]
        return hashlib.blake2b(b"[" + b"".join(d for d, _ in parts), digest_size=16).digest(), b"[" + b"\1".join(f for _, f in parts) + b"]"
    form = leaf(node)
    return hashlib.blake2b(form, digest_size=16).digest(), form


def payload_fields(payload: str | None) -> dict:
    """The object in a raw record; of one that is no JSON object nothing."""
    try:
        found = json.loads(payload) if payload else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def unpacked(tag, body, analytic, payload) -> tuple[str | None, str | None, bool]:
    """tag, body_text and is_analytic of a record, each from the payload where it lies there."""
    if payload is not None:
        raw = payload_fields(payload)
        tag = _text(raw.get("tag")) if tag is None else tag
        body = _text(raw.get("body_text")) if body is None else body
        analytic = raw.get("is_analytic") if analytic is None else analytic
    return tag, body, flag(analytic)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, roots, forms = [], [], []
        for rid, *raw in zip(*(batch.column(n).to_pylist() for n in ("record_id", "tag", "body_text", "is_analytic", "payload")), strict=True):
            tag, body, analytic = unpacked(*raw)
            digest, form = canonical({"tag": tag, "body_text": body, "is_analytic": analytic})
            if squeezed(tag) or squeezed(body):
                ids.append(rid)
                roots.append(digest)
                forms.append(form)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.binary()), pa.array(forms, pa.binary())], names=["record_id", "root", "form"])


def same_records(records: DataFrame) -> DataFrame:
    """(first_id, n_copies) of each set of two or more records that differ in writing only.

    ``records`` has record_id, tag, body_text, is_analytic and payload. Null and empty
    texts agree, a null flag is false, records without a letter or digit in tag and body
    are left out; repeated rows count as copies. Copies collapse before the exchange, so
    one set may hold any share of all rows. Extra columns are ignored; an empty table
    gives an empty result.
    """
    rows = records.select("record_id", "tag", "body_text", "is_analytic", "payload")
    forms = rows.mapInArrow(_digests, "record_id bigint, root binary, form binary")
    groups = forms.groupBy("root", "form").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return groups.where("n_copies > 1").select("first_id", "n_copies")
