"""Model bundles: a portable, hash-checked container of a manifest and binary artifacts.

Layout, little-endian: magic, version, manifest length, table length; manifest JSON; table JSON (id,
offset, length, sha256, mediaType of each artifact, sorted by id); the artifacts, one after another.
"""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.errors import BundleError

# Fixed values of the format.
MAGIC, VERSION, HEADER = b"WLRN", 1, 16


def stable_json(value) -> str:
    """JSON with sorted keys and no white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def encode_json(value) -> bytes:
    return stable_json(value).encode()


def decode_json(raw: bytes):
    return json.loads(bytes(raw).decode())


def encode_bundle(manifest: dict, artifacts: list[dict]) -> bytes:
    """A bundle of artifacts {id, data, mediaType?}."""
    entries, blobs, at = [], [], 0
    for a in sorted(artifacts, key=lambda x: x["id"]):
        data = bytes(a["data"])
        entries.append({"id": a["id"], "offset": at, "length": len(data), "sha256": hashlib.sha256(data).hexdigest()} | ({"mediaType": a["mediaType"]} if a.get("mediaType") else {}))
        blobs.append(data)
        at += len(data)
    if len({e["id"] for e in entries}) < len(entries):
        raise BundleError("two artifacts share an id")
    head, toc = encode_json(manifest | {"bundleVersion": VERSION}), encode_json(entries)
    return b"".join([struct.pack("<4sIII", MAGIC, VERSION, len(head), len(toc)), head, toc, *blobs])


def decode_bundle(raw: bytes) -> tuple[dict, list[dict], dict[str, bytes]]:
    """(manifest, table, blobs), after checks of structure and bounds."""
    raw = bytes(raw)
    if len(raw) < HEADER:
        raise BundleError(f"a bundle has at least {HEADER} bytes; this has {len(raw)}")
    magic, version, n_head, n_toc = struct.unpack_from("<4sIII", raw)
    if magic != MAGIC:
        raise BundleError(f"bad magic {magic!r}")
    if version != VERSION:
        raise BundleError(f"unsupported version {version}")
    start = HEADER + n_head + n_toc
    if start > len(raw):
        raise BundleError("the bundle is cut off in its manifest or table")
    try:
        manifest, toc = decode_json(raw[HEADER : HEADER + n_head]), decode_json(raw[HEADER + n_head : start])
    except ValueError as e:
        raise BundleError(f"the manifest or table isn't JSON: {e}") from e
    if not isinstance(toc, list) or not isinstance(manifest, dict):
        raise BundleError("the manifest isn't an object or the table isn't a list")
    room, spans, blobs = len(raw) - start, [], {}
    for e in toc:
        at, n = e.get("offset"), e.get("length")
        if not isinstance(at, int) or not isinstance(n, int) or at < 0 or n < 0 or at + n > room:
            raise BundleError(f"artifact {e.get('id')!r} lies outside the bundle")
        if n:
            spans.append((at, at + n, e["id"]))
        blobs[e["id"]] = raw[start + at : start + at + n]
    spans.sort()
    for (_, end, a), (begin, _, b) in zip(spans, spans[1:], strict=False):
        if begin < end:
            raise BundleError(f"artifacts {a!r} and {b!r} overlap")
    return manifest, toc, blobs


def validate_bundle(raw: bytes) -> tuple[dict, list[dict], dict[str, bytes]]:
    """As decode_bundle, with every artifact's hash checked."""
    manifest, toc, blobs = decode_bundle(raw)
    for e in toc:
        if hashlib.sha256(blobs[e["id"]]).hexdigest() != e.get("sha256"):
            raise BundleError(f"artifact {e['id']!r} doesn't match its hash")
    return manifest, toc, blobs


def little_endian(content: Column, at: int) -> Column:
    """The unsigned 32-bit number at a byte offset of a binary column."""
    hexes = [F.hex(F.substring(content, at + 1 + k, 1)) for k in (3, 2, 1, 0)]
    return F.conv(F.concat(*hexes), 16, 10).cast("long")


def catalogue(bundles: DataFrame, content: str = "content") -> DataFrame:
    """Per artifact of each bundle in a binary column: type id, artifact id, length, whether its hash fits.

    Runs inside Spark's own expressions, for scans over many bundle files (`binaryFile`).
    """
    c = F.col(content)
    n_head, n_toc = little_endian(c, 8), little_endian(c, 12)
    step = bundles.where(F.substring(c, 1, 4) == F.lit(MAGIC)).withColumn("_head", n_head).withColumn("_toc", n_toc)
    text = lambda at, n: F.decode(F.expr(f"substring({content}, {at}, {n})"), "UTF-8")
    step = step.withColumn("_manifest", text(f"{HEADER + 1}", "int(_head)")).withColumn("_entries", F.from_json(text(f"int({HEADER + 1} + _head)", "int(_toc)"), "array<struct<id:string,offset:long,length:long,sha256:string>>"))
    step = step.select(content, "_head", "_toc", F.get_json_object("_manifest", "$.typeId").alias("type_id"), F.explode("_entries").alias("e"))
    blob = F.expr(f"substring({content}, int({HEADER + 1} + _head + _toc + e.offset), int(e.length))")
    return step.select("type_id", F.col("e.id").alias("artifact"), F.col("e.length").alias("length"), (F.sha2(blob, 256) == F.col("e.sha256")).alias("valid"))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)
