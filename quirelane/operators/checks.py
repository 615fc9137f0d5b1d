"""Integrity and validity: tags of cache entries, schemas of output documents, text of bytes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Block size of SHA-256, and the bytes that the standard's two keys are mixed with.
_BLOCK, _INNER, _OUTER = 64, 0x36, 0x5C


def hmac(key: bytes, body: Column) -> Column:
    """HMAC-SHA256 of binary data as hex, by the hash function alone."""
    import hashlib

    k = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(b ^ _INNER for b in k)), body), 256))
    return F.sha2(F.concat(F.lit(bytes(b ^ _OUTER for b in k)), inner), 256)


def schema_problems(documents: DataFrame, schema: StructType | str, column: str = "json") -> DataFrame:
    """Adds ``problem``: not_json, version or shape, of documents that don't follow the output's schema; else null."""
    parsed = F.from_json(F.col(column), schema, {"mode": "PERMISSIVE"})
    version = F.get_json_object(column, "$.schema_version")
    plain = F.try_parse_json(F.col(column)).isNull()
    return documents.withColumn("problem", F.when(plain, "not_json").when(version.isNull() | ~version.rlike("^1\\."), "version").when(parsed.isNull() | F.get_json_object(column, "$.pages").isNull(), "shape"))


def decoded(data: Column, encoding: str) -> Column:
    """(text, ok) of bytes in an encoding that Spark's own decoder lacks, such as those of East Asian files."""

    @F.pandas_udf("text string, ok boolean")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for b in s:
            try:
                rows.append((None if b is None else b.decode(encoding), True))
            except UnicodeDecodeError:
                rows.append((b.decode(encoding, "replace"), False))
        return pd.DataFrame(rows, columns=["text", "ok"])

    return run(data)


def text_string(data: Column) -> Column:
    """Text of a document's string bytes: UTF-16 or UTF-8 by its mark, else Latin 1."""
    head2, head3 = F.hex(F.substring(data, 1, 2)), F.hex(F.substring(data, 1, 3))
    n = F.octet_length(data)
    return (
        F.when(head2 == "FEFF", F.decode(F.substring(data, 3, n), "UTF-16BE"))
        .when(head2 == "FFFE", F.decode(F.substring(data, 3, n), "UTF-16LE"))
        .when(head3 == "EFBBBF", F.decode(F.substring(data, 4, n), "UTF-8"))
        .otherwise(F.decode(data, "ISO-8859-1"))
    )


def xfa_fields(packets: DataFrame, key: str = "doc_id", column: str = "xml") -> DataFrame:
    """(key, name, value): leaf elements below the data element of form packets, names joined by dots. Broken XML: none."""
    import xml.etree.ElementTree as ET

    def leaves(text: str) -> list[tuple[str, str]]:
        try:
            root = ET.fromstring(text)
        except ET.ParseError:
            return []
        plain = lambda e: e.tag.rpartition("}")[2]
        data = next((e for e in root.iter() if plain(e) == "data"), root)
        out: list[tuple[str, str]] = []

        def walk(e, path: list[str]) -> None:
            if len(e) == 0:
                out.append((".".join(path), (e.text or "").strip()))
            for child in e:
                walk(child, [*path, plain(child)])

        for child in data:
            walk(child, [plain(child)])
        return out

    @F.pandas_udf("array<struct<name:string,value:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else [{"name": n, "value": v} for n, v in leaves(t)])

    return packets.select(key, F.explode(run(F.col(column))).alias("f")).select(key, "f.name", "f.value")
