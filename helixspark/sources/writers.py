"""FASTQ, BAM and BCF files from tables, one for each partition."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..vector.store import Files
from .binary import BASE_CODES

BGZF_BLOCK = 60_000
#: The empty block that ends a blocked gzip file.
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
QUAL_MISSING = 0x7F800001


def bgzf(data: bytes) -> bytes:
    """Blocked gzip: members of at most 64 KB that name their own size."""
    out = []
    for at in range(0, len(data), BGZF_BLOCK):
        part = data[at : at + BGZF_BLOCK]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        extra = struct.pack("<2sHH", b"BC", 2, len(body) + 25)
        out.append(b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + BGZF_END


def fastq_file(rows: Iterable[dict]) -> bytes:
    """Records of ``seq, qual``, gzipped."""
    return gzip.compress("".join(f"@read{k}\n{r['seq']}\n+\n{r['qual']}\n" for k, r in enumerate(rows)).encode(), mtime=0)


def bam_file(rows: Iterable[dict]) -> bytes:
    """Unplaced alignments of ``flag, mapq, seq`` without references."""
    out = [b"BAM\x01", struct.pack("<i", 4), b"@HD\n", struct.pack("<i", 0)]
    for r in rows:
        codes = [max(BASE_CODES.find(c), 0) for c in r["seq"].upper()]
        codes += [0] * (len(codes) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        n = len(r["seq"])
        fixed = struct.pack("<iiBBHHHiiii", -1, -1, 2, 255 if r["mapq"] is None else r["mapq"], 4680, 0, r["flag"], n, -1, -1, 0)
        body = fixed + b"r\0" + packed + b"\xff" * n
        out.append(struct.pack("<i", len(body)) + body)
    return bgzf(b"".join(out))


def _typed(kind: int, n: int, body: bytes) -> bytes:
    if n < 15:
        return bytes([n << 4 | kind]) + body
    return bytes([0xF0 | kind]) + _integers([n]) + body


def _integers(values: list[int]) -> bytes:
    return _typed(3, len(values), struct.pack(f"<{len(values)}i", *values))


def _letters(text: str) -> bytes:
    raw = text.encode()
    return _typed(7, len(raw), raw)


def bcf_file(rows: Iterable[dict], samples: tuple[str, ...] = ()) -> bytes:
    """Variants of ``chrom, pos, ids, ref, alts, qual, filters``, without INFO and genotypes."""
    rows = list(rows)
    contigs = {c: k for k, c in enumerate(sorted({r["chrom"] for r in rows}))}
    filters = {f: k + 1 for k, f in enumerate(sorted({f for r in rows for f in r["filters"]} - {"PASS"}))} | {"PASS": 0}
    lines = ["##fileformat=VCFv4.3", *[f'##FILTER=<ID={f},Description="",IDX={k}>' for f, k in filters.items()], *[f"##contig=<ID={c},IDX={k}>" for c, k in contigs.items()]]
    lines.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]))
    header = ("\n".join(lines) + "\n\0").encode()
    out = [b"BCF\x02\x02", struct.pack("<I", len(header)), header]
    for r in rows:
        alleles = [r["ref"], *r["alts"]]
        qual = struct.pack("<I", QUAL_MISSING) if r["qual"] is None else struct.pack("<f", r["qual"])
        body = struct.pack("<iii", contigs[r["chrom"]], r["pos"] - 1, len(r["ref"])) + qual + struct.pack("<HHI", 0, len(alleles), len(samples))
        body += _letters(";".join(r["ids"]) or ".") + b"".join(map(_letters, alleles)) + _integers([filters[f] for f in r["filters"]])
        out.append(struct.pack("<II", len(body), 0) + body)
    return bgzf(b"".join(out))


def write_files(rows: DataFrame, path: str, encode: Callable[[Iterable[dict]], bytes], ending: str) -> int:
    """One file for each partition of ``rows``, made by its task and written by the driver, which holds one at a time; their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content = encode(row for batch in batches for row in batch.to_pylist())
        yield pa.RecordBatch.from_pydict({"content": pa.array([content], pa.binary())})

    files, n = Files(rows.sparkSession), 0
    for row in rows.mapInArrow(run, "content binary").toLocalIterator():
        files.write(f"{path}/part-{n:05d}.{ending}", bytes(row["content"]))
        n += 1
    return n
