"""Sections, segments and code fingerprints of ELF files, from their bytes.

Offsets in a header say where the next part lies, which column expressions cannot follow;
each file is one row's bytes and is parsed in an Arrow-batched UDF. Files that are no
ELF, or are cut off, have no parts.
"""

from __future__ import annotations

import hashlib
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,name:string,type:bigint,flags:bigint,address:decimal(20,0),offset:bigint,size:bigint>>"


def _header(data: bytes) -> dict | None:
    if len(data) < 52 or data[:4] != b"\x7fELF":
        return None
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    names = ("entry", "phoff", "shoff", "flags", "ehsize", "phentsize", "phnum", "shentsize", "shnum", "shstrndx")
    return dict(zip(names, struct.unpack_from(order + ("QQQIHHHHHH" if wide else "IIIIHHHHHH"), data, 24), strict=True)) | {"wide": wide, "order": order}


def segments(data: bytes) -> list[dict]:
    head, out = _header(data), []
    for i in range(head["phnum"] if head else 0):
        at = head["phoff"] + i * head["phentsize"]
        if head["wide"]:
            kind, flags, offset, address, _, size = struct.unpack_from(head["order"] + "IIQQQQ", data, at)
        else:
            kind, offset, address, _, size, _, flags = struct.unpack_from(head["order"] + "IIIIIII", data, at)
        out.append({"kind": "segment", "name": None, "type": kind, "flags": flags, "address": address, "offset": offset, "size": size})
    return out


def sections(data: bytes) -> list[dict]:
    head, out = _header(data), []
    for i in range(head["shnum"] if head else 0):
        at = head["shoff"] + i * head["shentsize"]
        name, kind, flags, address, offset, size = struct.unpack_from(head["order"] + ("IIQQQQ" if head["wide"] else "IIIIII"), data, at)
        out.append({"kind": "section", "name": name, "type": kind, "flags": flags, "address": address, "offset": offset, "size": size})
    table = out[head["shstrndx"]] if head and head["shstrndx"] < len(out) else None
    for s in out:
        raw = data[table["offset"] + s["name"] : table["offset"] + table["size"]] if table else b""
        s["name"] = raw.split(b"\0")[0].decode("utf-8", "replace")
    return out


def _parts(data: bytes | None) -> list[dict]:
    from decimal import Decimal

    try:
        return [p | {"address": Decimal(p["address"])} for p in segments(data or b"") + sections(data or b"")]
    except struct.error:
        return []


def code_digest(data: bytes | None) -> dict | None:
    """One digest over the loaded executable segments, each after its length; None without any."""
    try:
        code = [data[s["offset"] : s["offset"] + s["size"]] for s in segments(data or b"") if s["type"] == 1 and s["flags"] & 1]
    except struct.error:
        code = []
    if not code:
        return None
    return {"sha256": hashlib.sha256(b"".join(struct.pack(">Q", len(c)) + c for c in code)).hexdigest(), "size_bytes": sum(map(len, code)), "segments": len(code)}


def parts(files: DataFrame) -> DataFrame:
    """path, kind, name, type, flags, address, offset, size. ``files``: path, content."""

    @F.pandas_udf(PARTS)
    def run(content: pd.Series) -> pd.Series:
        return content.map(_parts)

    return files.select("path", F.explode(run("content")).alias("p")).select("path", "p.*")


def fingerprints(files: DataFrame) -> DataFrame:
    """path, sha256, size_bytes, segments of executable code; NULLs where there is none."""

    @F.pandas_udf("struct<sha256:string,size_bytes:bigint,segments:int>")
    def run(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([code_digest(x) or {"sha256": None, "size_bytes": None, "segments": None} for x in content], columns=["sha256", "size_bytes", "segments"])

    return files.select("path", run("content").alias("f")).select("path", "f.*")
