"""Content-addressed payloads in tar shards, with metadata columns filled by header-only range reads.

Each distinct payload is stored once, under the name of its SHA-256, in a tar shard; rows carry digest, shard, offset and
length. Map tasks write the shards where they read, so payloads are never shuffled; of the digests that occur more than
once (only those are gathered) the least key owns the payload. Images and sound, which are packed already, are members as they come; text
is a member of two Zstandard frames, the first of which holds the header: HEADER_BYTES, or in HTML all up to the end of the head
element. Metadata come from a range read of that frame (of `head` bytes) alone, or of HEADER_BYTES of a member that is stored as it
came; a JPEG whose size lies further on is followed from segment to segment by further range reads of a few bytes.

Defined results: a null payload gives null media columns; an empty one is stored like any other, with raw_bytes 0 and kind
"empty"; repeated rows (also rows with one key and several payloads) share the stored copy of their digest; an empty table
gives an empty result; other columns are ignored. A shard's name has the number of the attempt that wrote it, so tasks that run again never
touch each other's shards; the index names those of the attempt that counts.
"""

from __future__ import annotations

import io
import re
import struct
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, sized

HEADER_BYTES = 1024
SHARD_BYTES = 256 << 20
INDEX = ["digest", "shard", "offset", "length", "raw_bytes", "head"]
INDEX_SCHEMA = "digest string, shard string, offset long, length long, raw_bytes long, head long"
META = ["kind", "width", "height", "charset", "lang", "title"]
META_SCHEMA = "kind string, width int, height int, charset string, lang string, title string"

_CHARSET = re.compile(rb"""<meta[^>]*charset=["']?([\w-]+)""", re.I)
_LANG = re.compile(rb"""<html[^>]*\blang=["']?([\w-]+)""", re.I)
_TITLE = re.compile(rb"<title[^>]*>(.*?)</title>", re.I | re.S)


_HEAD_END = re.compile(rb"</head\s*>|<body\b", re.I)


def as_it_comes(data: bytes) -> bool:
    """Whether a payload is of a kind that is packed already."""
    return data[:8] == b"\x89PNG\r\n\x1a\n" or data[:6] in (b"GIF87a", b"GIF89a") or data[:2] == b"\xff\xd8" or data[:4] == b"RIFF"


def header_size(data: bytes, least: int = HEADER_BYTES) -> int:
    """Bytes of a text payload that its header takes."""
    low = data[:256].lstrip().lower()
    if low.startswith(b"<!doctype html") or b"<html" in low:
        end = _HEAD_END.search(data)
        return min(len(data), max(least, end.end() if end else 0))
    return min(len(data), least)


def read_header(head: bytes, more=None) -> dict:
    """Metadata that the first bytes of a payload tell, with more(offset, n) to read further ones; what they don't tell is None."""
    out = dict.fromkeys(META)
    if not head:
        return out | {"kind": "empty"}
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        w, h = struct.unpack(">II", head[16:24])
        return out | {"kind": "png", "width": w, "height": h}
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        w, h = struct.unpack("<HH", head[6:10])
        return out | {"kind": "gif", "width": w, "height": h}
    if head[:2] == b"\xff\xd8":
        at = 2
        while True:
            part = head[at : at + 9] if at + 9 <= len(head) else more(at, 9) if more else b""
            if len(part) < 9 or part[0] != 0xFF:
                return out | {"kind": "jpeg"}
            if 0xC0 <= part[1] <= 0xCF and part[1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", part[5:9])
                return out | {"kind": "jpeg", "width": w, "height": h}
            at += 2 + struct.unpack(">H", part[2:4])[0]
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return out | {"kind": "wav"}
    low = head[:256].lstrip().lower()
    if low.startswith((b"<!doctype html", b"<html")) or b"<html" in low:
        charset, lang, title = (p.search(head) for p in (_CHARSET, _LANG, _TITLE))
        return out | {
            "kind": "html",
            "charset": charset and charset[1].decode("ascii").lower(),
            "lang": lang and lang[1].decode("ascii").lower(),
            "title": title and title[1].decode("utf-8", "replace").strip(),
        }
    return out | {"kind": "text"}


class _Shard:
    """A tar file written through; knows where each member's bytes begin."""

    def __init__(self, fs, root: str, name: str):
        self.f, self.at, self.name = fs.open_output_stream(f"{root}/{name}"), 0, name

    def add(self, member: str, data: bytes) -> int:
        info = tarfile.TarInfo(member)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.f.write(head)
        self.f.write(data)
        self.f.write(b"\0" * (-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % 512
        return offset

    def close(self):
        self.f.write(b"\0" * 1024)
        self.f.close()


def store(rows: DataFrame, key: str, payload: str, root: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the distinct payloads of `rows`; the index (digest, shard, offset, length, raw_bytes, head), one row a digest; head is the
    length of the first frame, 0 for a member stored as it came."""
    fs, path = pafs.FileSystem.from_uri(root)
    fs.create_dir(path, recursive=True)
    content = F.col(payload).cast("binary")
    base = rows.where(F.col(payload).isNotNull()).select(F.col(key).alias("k"), F.sha2(content, 256).alias("digest"), content.alias("payload"))
    many = base.groupBy("digest").agg(F.count("*").alias("n"), F.min("k").alias("owner")).where("n > 1").select("digest", "owner")
    many = sized(materialize(many, "media-repeats"), 120)
    mine = base.join(many, "digest", "left").where(F.col("owner").isNull() | (F.col("owner") == F.col("k"))).select("digest", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_fs, out_path = pafs.FileSystem.from_uri(root)
        packer = zstandard.ZstdCompressor(level=6)
        seen: set[str] = set()
        shard, count = None, 0
        for b in batches:
            got = []
            for digest, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                if shard is None or shard.at > shard_bytes:
                    if shard:
                        shard.close()
                    shard, count = _Shard(out_fs, out_path, f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{count:04d}.tar"), count + 1
                data = data.as_py()
                if as_it_comes(data):
                    body, head = data, 0
                else:
                    cut = header_size(data)
                    first = packer.compress(data[:cut])
                    body, head = first + (packer.compress(data[cut:]) if cut < len(data) else b""), len(first)
                offset = shard.add(digest + (".zst" if head else ""), body)
                got.append((digest, shard.name, offset, len(body), len(data), head))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.string() if i < 2 else pa.int64()) for i in range(6)], INDEX)
        if shard:
            shard.close()

    # written first: the shards' own record of places is the only one that counts afterwards
    index = materialize(mine.mapInArrow(run, INDEX_SCHEMA), "media-index")
    best = index.groupBy("digest").agg(F.min(F.struct(*INDEX[1:])).alias("p"))
    return best.select("digest", *[f"p.{c}" for c in INDEX[1:]])


def member_bytes(root: str, shard: str, offset: int, length: int, head: int) -> bytes:
    """A whole payload, by a range read of the shard."""
    fs, path = pafs.FileSystem.from_uri(root)
    with fs.open_input_file(f"{path}/{shard}") as f:
        f.seek(offset)
        data = f.read(length)
    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() if head else data


def member_header(read, length: int, head: int) -> dict:
    """Metadata of a member whose bytes [a, a + n) read(a, n) gives."""
    if head:
        return read_header(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(read(0, head))).read())
    return read_header(read(0, min(HEADER_BYTES, length)), lambda at, n: read(at, min(n, max(0, length - at))))


def with_metadata(index: DataFrame, root: str) -> DataFrame:
    """`index` with the columns META and read_bytes (bytes that were read for them), read in the order of the shards."""

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(root)
        f, name = None, None
        for b in batches:
            metas = []
            for shard, offset, length, head in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 5)), strict=True):
                if shard != name:
                    if f:
                        f.close()
                    f, name = fs.open_input_file(f"{path}/{shard}"), shard
                total = 0

                def read(at, n, f=f, offset=offset):
                    nonlocal total
                    total += n
                    f.seek(offset + at)
                    return f.read(n)

                metas.append(member_header(read, length, head) | {"read_bytes": total})
                metas[-1]["read_bytes"] = total
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
            cols = [pa.array([m[c] for m in metas], k) for c, k in zip([*META, "read_bytes"], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*INDEX, *META, "read_bytes"])
        if f:
            f.close()

    placed = index.select(*INDEX).repartition("shard").sortWithinPartitions("shard", "offset")
    return placed.mapInArrow(run, f"{INDEX_SCHEMA}, {META_SCHEMA}, read_bytes long")


def media_columns(rows: DataFrame, key: str = "page_id", payload: str = "html", root: str | None = None) -> DataFrame:
    """(key, digest, shard, offset, length, raw_bytes, head, META...) for every row of `rows`."""
    root = root or fresh_path(rows.sparkSession, "media")
    meta = materialize(with_metadata(store(rows, key, payload, root), root), "media-meta")
    ids = rows.select(F.col(key), F.sha2(F.col(payload).cast("binary"), 256).alias("digest"))
    return ids.join(meta, "digest", "left").select(key, *INDEX, *META)
