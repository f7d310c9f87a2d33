"""Files of each format with awkward records, against plain models."""

import gzip
import json
import struct
import zlib

import pytest

from helixspark.operators import formats, orf, tfidf
from helixspark.sources import text


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">s1 a > description\nACGT\nacgu\n>s2\nNNNN\n>s3 last\n")
    rows = [tuple(r) for r in formats.read_fasta_stats(spark, str(p)).collect()]
    assert rows == [(0, "s1", "a > description", 8, 50.0), (1, "s2", "", 4, 0.0), (2, "s3", "last", 0, 0.0)]
    (tmp_path / "empty.fa").write_text("")
    assert formats.read_fasta_stats(spark, str(tmp_path / "empty.fa")).count() == 0


@pytest.mark.parametrize("packed", [False, True])
def test_fastq(spark, tmp_path, packed):
    p = tmp_path / ("r.fq.gz" if packed else "r.fq")
    body = "@r1\nACGN\n+\n5?@!\n@r2\nUU\n+r2\n@5\n".encode()
    p.write_bytes(gzip.compress(body) if packed else body)
    r = formats.read_fastq_stats(spark, str(p)).first()
    scores = [20, 30, 31, 0, 31, 20]
    assert (r["read_count"], r["total_bases"]) == (2, 6) and r["avg_quality"] == pytest.approx(sum(scores) / 6)
    assert r["q20_percent"] == pytest.approx(500 / 6) and r["q30_percent"] == pytest.approx(50) and r["gc_percent"] == pytest.approx(200 / 3)


def test_malformed_fastq_fails(spark, tmp_path):
    (tmp_path / "b.fq").write_text("@r\nAC\n+\n5\n")
    with pytest.raises(Exception, match="malformed"):
        formats.read_fastq_stats(spark, str(tmp_path / "b.fq")).collect()


def blocked(data: bytes) -> bytes:
    """Blocked gzip of small blocks, as BAM and BCF writers make it."""
    out = b""
    for at in range(0, len(data), 37):
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        part = data[at : at + 37]
        body = z.compress(part) + z.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def alignment(flag, mapq, seq):
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", 0, 5, 3, mapq, 0, 1, flag, len(seq), -1, -1, 0) + b"r1\0" + struct.pack("<I", len(seq) << 4) + packed + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    reads = [(0, 60, "ACGTN"), (4, 10, "GG"), (1 | 2, 255, "A"), (1024, 30, "CC"), (256, 0, "T" * 100)]
    data = b"BAM\x01" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    (tmp_path / "x.bam").write_bytes(blocked(data + b"".join(alignment(*r) for r in reads)))
    r = formats.read_bam_stats(spark, str(tmp_path / "x.bam")).first()
    assert tuple(r)[:7] == (5, 4, 1, 1, 1, 1, 110)
    assert r["avg_mapq"] == 25.0 and r["avg_length"] == 22.0 and r["gc_percent"] == pytest.approx(100 * 6 / 109)


VCF = """##fileformat=VCFv4.3
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
chr1\t10\trs1;rs2\tA\tG\t29.7\tPASS\tDP=14;DB\tGT\t0/1\t1/1
chr1\t20\t.\tA\tG,T\t.\t.\t.\tGT\t0/1\t1/1
chr2\t30\t.\tAT\tA\t50\tq10;s50\tDP=3\tGT\t0/1\t1/1
chr2\t40\t.\tAC\tGT\t10\tPASS\t.\tGT\t0/1\t1/1
chr2\t50\t.\tA\t.\t7\tPASS\t.\tGT\t0/1\t1/1
"""


def test_vcf(spark, tmp_path):
    p = tmp_path / "v.vcf"
    p.write_text(VCF)
    r = formats.read_vcf_stats(spark, str(p)).first()
    assert (r["variant_count"], r["snp_count"], r["indel_count"], r["multi_allelic_count"], r["pass_count"], r["chromosome_count"], r["sample_count"]) == (5, 3, 2, 1, 3, 2, 2)
    assert r["avg_qual"] == pytest.approx((29.700000762939453 + 50 + 10 + 7) / 4, abs=1e-9)
    rows, counts = formats.filter_vcf(spark, str(p), pass_only=True, max_variants=2)
    assert [x["pos"] for x in rows.orderBy("ordinal").collect()] == [10, 40] and tuple(counts.first()) == (4, 2)
    rows, counts = formats.filter_vcf(spark, str(p), min_quality=0.0, chromosome="chr1", region_start=10, region_end=20)
    assert [(x["id"], x["alt"], x["qual"], x["filter"]) for x in rows.orderBy("ordinal").collect()] == [("rs1;rs2", "G", 29.700000762939453, "PASS"), ("", "G,T", 0.0, "")]
    assert tuple(counts.first()) == (5, 2)
    assert formats.filter_vcf(spark, str(p), region_start=10)[1].first()["filtered_count"] == 5


def typed(values, kind="str"):
    if kind == "str":
        raw = values.encode()
        head = bytes([len(raw) << 4 | 7]) if len(raw) < 15 else bytes([0xF7, 0x11, len(raw)])
        return head + raw
    return bytes([len(values) << 4 | 1]) + struct.pack(f"<{len(values)}b", *values)


def test_bcf(spark, tmp_path):
    header = '##fileformat=VCFv4.3\n##FILTER=<ID=PASS,Description="ok, fine">\n##FILTER=<ID=q10,Description="low">\n##INFO=<ID=DP,Number=1,Type=Integer,Description="d">\n##contig=<ID=chr1>\n##contig=<ID=chr2>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\n\0'.encode()

    def record(chrom, pos, qual, alleles, filters, info=b"", n_info=0):
        bits = struct.pack("<f", qual) if qual is not None else struct.pack("<I", 0x7F800001)
        body = struct.pack("<iii", chrom, pos, 1) + bits + struct.pack("<HH", n_info, len(alleles)) + struct.pack("<I", 1) + typed("") + b"".join(map(typed, alleles)) + typed(filters, "int") + info
        return struct.pack("<II", len(body), 0) + body

    data = b"BCF\x02\x02" + struct.pack("<I", len(header)) + header
    data += record(0, 9, 29.5, ["A", "G"], [0], typed([2], "int") + typed([14], "int"), 1) + record(1, 19, None, ["AT", "A" * 20, "C"], [1]) + record(1, 29, 10.5, ["A"], [])
    (tmp_path / "v.bcf").write_bytes(blocked(data))
    r = formats.read_bcf_stats(spark, str(tmp_path / "v.bcf")).first()
    assert (r["variant_count"], r["snp_count"], r["indel_count"], r["multi_allelic_count"], r["pass_count"], r["avg_qual"], r["chromosome_count"], r["sample_count"]) == (3, 2, 1, 1, 1, 20.0, 2, 1)
    rows = spark.read.format("bcf").load(str(tmp_path / "v.bcf")).where("chrom is not null").orderBy("pos").collect()
    assert (rows[0]["chrom"], rows[0]["pos"], rows[0]["info"], rows[0]["filters"]) == ("chr1", 10, "DP=14", ["PASS"]) and rows[1]["filters"] == ["q10"]


def test_gff_and_bed(spark, tmp_path):
    (tmp_path / "g.gff").write_text("##gff-version 3\nc1\ts\tgene\t1\t10\t.\t+\t.\tID=1\nc1\ts\texon\t5\t5\t.\t-\t0\tID=2\nc2\tt\texon\t1\t2\t.\t?\t.\tx \"y\"\n\n# end\n")
    r = formats.read_gff_stats(spark, str(tmp_path / "g.gff")).first()
    assert tuple(r)[:7] == (3, 2, 2, 1, 1, 1, 12) and [tuple(x) for x in r["feature_types"]] == [("exon", 2), ("gene", 1)]
    (tmp_path / "b.bed").write_text("track name=x\nbrowser hide\n# c\nchr1\t1\t5\nchr1\t+5\t9\tn\r\nchr2\t-5\t3\nchr2\t 5\t9\nchr3 1 2\nchr3\t1\ntrack1\t1\t9\nchr4\t9\t1\n")
    r = formats.read_bed_stats(spark, str(tmp_path / "b.bed")).first()
    assert tuple(r)[:5] == (5, 3, 4 + 4 + 3 + 9 + 0, 0, 9) and [tuple(x) for x in r["chromosomes"]] == [("chr1", 2, 8), ("chr2", 2, 12), ("chr4", 1, 0)]
    (tmp_path / "e.bed").write_text("")
    assert tuple(formats.read_bed_stats(spark, str(tmp_path / "e.bed")).first())[:6] == (0, 0, 0, 0, 0, 0.0)


def test_tfidf_lifecycle(spark):
    index = tfidf.TfidfIndex(spark)
    docs = json.dumps([{"id": "m1", "tokens": ["samtools", "variant", "calling"]}, {"id": "m2", "tokens": ["bcftools", "filter", "variant"]}, {"id": "m3", "tokens": ["fastp", "qc", "过滤", "质控"]}])
    assert json.loads(index.info()) == {"ok": False, "reason": "empty"} and index.score_json('["a"]', 3) == "[]"
    assert index.ensure_json("k", "no json") == 0 and index.ensure_json("k", docs) == 1 and index.ensure_json("k", docs) == 0
    assert json.loads(index.info()) == {"ok": True, "key": "k", "n": 3, "dfSize": 9, "entriesLen": 3}
    assert [r["id"] for r in json.loads(index.score_json('["variant"]', 5))] == ["m1", "m2"]
    assert index.score_json('["nothing"]', 5) == "[]" and index.score_json("{", 5) == "[]"
    index.clear()
    assert index.ensure_json("k", docs) == 1


def test_orfs_like_a_greedy_scan(spark):
    import random

    from helixspark.functions.sequence import CODE, CODONS

    rng = random.Random(2)
    rows = [(k, "".join(rng.choice("ACGTNacgu-") for _ in range(rng.randrange(0, 400)))) for k in range(40)] + [(99, "ATGTAA"), (98, "")]
    table = dict(zip(CODONS, CODE, strict=True))

    def scan(seq):
        s = "".join(c for c in seq.upper().replace("U", "T") if c in "ACGTN")
        for strand, x in (("+", s), ("-", s[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            for frame in range(3):
                i = frame
                while i + 3 <= len(x):
                    if x[i : i + 3] != "ATG":
                        i += 3
                        continue
                    j = i
                    while j + 3 <= len(x) and x[j : j + 3] not in ("TAA", "TAG", "TGA"):
                        j += 3
                    if j + 3 > len(x):
                        break
                    size = j + 3 - i
                    if size >= 9:
                        start = i if strand == "+" else len(s) - i - size
                        yield start, start + size, size, strand, frame, "ATG", x[j : j + 3], "".join(table.get(x[k : k + 3], "X") for k in range(i, j, 3))
                    i = j + 3

    found = orf.find_orfs(spark.createDataFrame(rows, "seq_id long, seq string"), 9)
    assert sorted(tuple(r) for r in found.collect()) == sorted((k, *o) for k, s in rows for o in scan(s))


def test_lines_keep_their_order(spark, tmp_path):
    (tmp_path / "l.txt").write_text("\n".join(f"line{k}" for k in range(500)))
    rows = text._in_order(spark.read.option("maxPartitionBytes", "1k").text(str(tmp_path / "l.txt"))).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["value"]) for r in rows] == [(k, f"line{k}") for k in range(500)]


def test_motifs_like_a_mask_scan(spark):
    import random

    from helixspark.operators import motif

    rng = random.Random(7)
    rows = [(k, "".join(rng.choice("ACGTacguNR-é") for _ in range(rng.randrange(0, 60)))) for k in range(60)] + [(7, "ACACAC"), (7, "ACACAC"), (99, "")]
    for m in ("AC", "NNGG", "WAW", "a", "XQ", "GCGGCCGC"):
        masks = motif.motif_masks(m)
        want = []
        for k, s in rows:
            b = s.encode().decode("latin-1")
            for name, own in (("+", masks), ("-", motif.complement_masks(masks))):
                for i in range(len(b) - len(m) + 1):
                    if all(motif.MASKS.get(c.upper(), 15) & x if c.upper() in "ACGTU" else True for c, x in zip(b[i : i + len(m)], own, strict=True)):
                        want.append((k, i, i + len(m), b[i : i + len(m)], name))
        got = [tuple(r) for r in motif.find_motifs(spark.createDataFrame(rows, "seq_id long, seq string"), m).collect()]
        assert sorted(got) == sorted(want), m
    docs = spark.createDataFrame([(1, "GCGGCCGCGGCCGC"), (2, "gaattcGAATTC"), (3, "")], "seq_id long, seq string")
    got = sorted((r["seq_id"], r["enzyme_name"], r["position"], r["cut_position"]) for r in motif.find_restriction_sites(docs).collect())
    assert got == [(1, "NotI", 0, 2), (1, "NotI", 6, 8), (2, "EcoRI", 0, 1), (2, "EcoRI", 6, 7)]
    assert motif.find_motifs(docs, "").count() == 0 and motif.find_restriction_sites(docs, ["none"]).count() == 0
