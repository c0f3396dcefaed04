"""The BAM source on files written here."""

import json
import random
import re
import struct
import zlib

import numpy as np
import pytest

from tidestat.operators import modhist, reads
from tidestat.sources import bam, bam_batch, bam_index
from tidestat.sources.relations import Relations

BASES = "=ACMGRSVTWYHKDBN"
COMPLEMENT = str.maketrans("ACGT", "TGCA")
CODES = {"m": "mod_5mC", "h": "mod_5hmC", "a": "mod_6mA"}


# a plain decoder, one record and one call at a time


def modifications(bases: str, reverse: bool, mm: str, ml: list[int]) -> list[tuple[int, str, int]]:
    """(position, modification, probability 0..255) of the calls in the MM and ML tags.

    Positions count from 1 along the stored bases; calls of codes outside CODES are left out. Several codes of one group (as
    in C+mh) share positions and take their probabilities in turn.
    """
    original = bases[::-1].translate(COMPLEMENT) if reverse else bases
    out, k, n = [], 0, len(bases)
    for group in mm.split(";"):
        head, *skips = group.split(",")
        m = re.fullmatch(r"([ACGTUN])([+-])([a-z]+|\d+)[.?]?", head)
        if not m:
            continue
        base = m[1].replace("U", "T")
        codes = [m[3]] if m[3].isdigit() else list(m[3])
        strand = original if m[2] == "+" else original.translate(COMPLEMENT)
        at = -1
        for skip in map(int, skips):
            for _ in range(skip + 1):
                at = at + 1 if base == "N" else strand.find(base, at + 1)
                if at < 0 or at >= n:
                    raise ValueError("an MM tag points beyond the read")
            for code in codes:
                if code in CODES:
                    out.append((n - at if reverse else at + 1, CODES[code], ml[k] if k < len(ml) else 255))
                k += 1
    return sorted(out)


def alignment(cigar: list[int], left0: int) -> tuple[list[tuple[int, int, int]], int]:
    """Aligned runs as (first base from 1, first genome position from 1, length), and the bases of genome spanned."""
    out, read, genome = [], 1, left0 + 1
    for c in cigar:
        n, op = c >> 4, "MIDNSHP=X"[c & 15]
        if op in "M=X":
            out.append((read, genome, n))
        read += n * (op in "MIS=X")
        genome += n * (op in "MDN=X")
    return out, genome - left0 - 1


def pack(data, size=3000):
    """Bytes as blocks of at most `size` unpacked bytes, with the end block."""
    out = b""
    for lo in [*range(0, len(data), size), None]:
        part = data[lo : lo + size] if lo is not None else b""
        c = zlib.compressobj(wbits=-15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def record(name, tid, left, bases, cigar=(), flag=0, mm="", ml=(), nl=(), al=()):
    codes = [BASES.index(b) for b in bases] + [0] * (len(bases) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    tags = b""
    if mm:
        tags += b"MMZ" + mm.encode() + b"\0MLBC" + struct.pack("<I", len(ml)) + bytes(ml)
    for t, v in (("nl", nl), ("al", al)):
        tags += t.encode() + b"BI" + struct.pack(f"<I{len(v)}I", len(v), *v)
    tags += b"NMi" + struct.pack("<i", 3) + b"XYAq"
    n = name.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", tid, left, len(n), 60, 0, len(cigar), flag, len(bases), -1, -1, 0) + n
    body += b"".join(struct.pack("<I", k << 4 | "MIDNSHP=X".index(op)) for k, op in cigar) + packed + b"\xff" * len(bases) + tags
    return struct.pack("<i", len(body)) + body


def header(contigs):
    out = b"BAM\x01" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", len(contigs))
    for n, size in contigs:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    return out


def test_modifications():
    assert modifications("ACCAC", False, "C+m?,1,0;A+a,1;", [10, 20, 30]) == [(3, "mod_5mC", 10), (4, "mod_6mA", 30), (5, "mod_5mC", 20)]
    assert modifications("GTGG", True, "C+mh,0,1;", [1, 2, 3, 4]) == [(1, "mod_5hmC", 4), (1, "mod_5mC", 3), (4, "mod_5hmC", 2), (4, "mod_5mC", 1)]
    assert modifications("ACGT", False, "T-a,0;C+76792,0;", [9, 8]) == [(1, "mod_6mA", 9)]


def test_alignment():
    cigar = [5 << 4 | 4, 3 << 4 | 0, 2 << 4 | 1, 4 << 4 | 2, 6 << 4 | 7]
    assert alignment(cigar, 100) == ([(6, 101, 3), (11, 108, 6)], 13)


def test_read(spark, tmp_path):
    rng = random.Random(1)
    body = header([("chr2", 10**6), ("chrX", 10**6)])
    body += record("a", 1, 99, "ACCAC", [(1, "S"), (4, "M")], mm="C+m,0,1;", ml=[230, 5], nl=[147], al=[30, 40])
    body += record("u", -1, -1, "AC")
    for i in range(400):
        n = rng.randint(20, 300)
        body += record(f"r{i}", i % 2, rng.randint(0, 9000), "".join(rng.choice("ACGT") for _ in range(n)), [(n, "M")], flag=16 * (i % 3 == 0))
    (tmp_path / "x.bam").write_bytes(pack(body))
    rows = bam.read_bam(spark, str(tmp_path / "x.bam")).collect()
    first = rows[0]
    assert (first.tid, first.qlen, first.left0, first.right1) == (1, 5, 99, 103) and first.nuc_len == [147] and first.msp_len == [30, 40]
    assert [tuple(m) for m in first.mods] == [(2, "mod_5mC", 230, 100), (5, "mod_5mC", 5, 103)]
    assert rows[1].tid == -1 and len(rows) == 402 and len({r.read_id for r in rows}) == 402
    plain = sorted((r.tid, r.left0, r.qlen, r.right1) for r in rows)
    for width in (700, 2500, 9000):  # ranges that start inside blocks and records
        cut = bam.read_bam(spark, str(tmp_path), width)
        assert cut.rdd.getNumPartitions() > 1
        assert sorted((r.tid, r.left0, r.qlen, r.right1) for r in cut.collect()) == plain
    rel = Relations(bam.read_bam(spark, str(tmp_path)), bam.bam_contigs(spark, str(tmp_path)))
    assert [(r.chrom, r["count"]) for r in reads.chrom_counts(rel.reads, rel.contigs).collect()] == [("chr2", 200), ("chrX", 201), ("*", 1)]
    assert modhist.mod_hist(rel.mod_calls).where("ml = 230").first()["mod_5mC"] == 1


def test_run_of_a_bam_and_a_yaml(spark, tmp_path, caplog):
    import tidestat

    rng = random.Random(2)
    body = header([("chr1", 10**6)])
    for i in range(30):
        body += record(f"r{i}", 0, 10 * i, "".join(rng.choice("ACGT") for _ in range(50 + i)), [(50 + i, "M")], mm="C+m,0;", ml=[240], nl=[20])
    (tmp_path / "S1").mkdir()
    (tmp_path / "S1/x.bam").write_bytes(pack(body))
    (tmp_path / "r.csv").write_text("chrom,start,stop\nchr1,90,110\nchrZ,5,9\n")
    (tmp_path / "c.yaml").write_text(f"stats: [ReadLengthCounter, ModHist, MetaPlot]\nconfigs: {{MetaPlot: [{{file: {tmp_path}/r.csv, label: L, width: 30}}]}}\n")
    with caplog.at_level("INFO", "tidestat"):
        saved = tidestat.run_bam(spark, str(tmp_path / "S1/x.bam"), str(tmp_path / "c.yaml"))
    assert saved.path == str(tmp_path / "S1/stats") and saved.stats["ReadLengthCounter"].selectExpr("sum(count)").first()[0] == 30
    assert saved.stats["MetaPlot"].selectExpr("sum(BG)").first()[0] > 0
    assert "chrZ" in caplog.text and "the first" not in caplog.text and "output" in caplog.text
    some = tidestat.run_bam(spark, str(tmp_path / "S1/x.bam"), str(tmp_path / "c.yaml"), str(tmp_path / "out"), nr=7)
    assert some.stats["ReadLengthCounter"].selectExpr("sum(count)").first()[0] == 7
    assert "<html" in open(tidestat.run_report(spark, str(tmp_path / "out"), str(tmp_path / "r.html"))).read().lower()


def plain_calls(tid, left, bases, cigar, flag, mm, ml):
    runs, span = alignment([k << 4 | "MIDNSHP=X".index(op) for k, op in cigar], left)
    out = []
    for pos, mod, prob in modifications(bases, bool(flag & 16), mm, list(ml)) if mm else []:
        on = [g + pos - r for r, g, n in runs if r <= pos < r + n]
        out.append((pos, mod, prob, on[0] if on and tid >= 0 else None))
    return out, left + span


def random_record(rng, i):
    n = rng.choice([0, 1, 2, 37, 150, 401])
    bases = "".join(rng.choice("ACGTN") for _ in range(n))
    cigar, left = [], n
    while left:
        k = rng.randint(1, left)
        op = rng.choice("MMM=XSI")
        cigar.append((k, op))
        left -= k
        if rng.random() < 0.4:
            cigar.append((rng.randint(1, 9), rng.choice("DNHP")))
    flag = rng.choice([0, 16])
    original = bases[::-1].translate(COMPLEMENT) if flag else bases
    groups, n_ml = [], 0
    for head, base in (("C+m", "C"), ("C+mh?", "C"), ("A+a.", "A"), ("T-a", "A"), ("N+m", None), ("C+76792", "C"), ("U+h", "T"), ("G-m", "C"), ("q?", "C")):
        if rng.random() < 0.5:
            here = n if base is None else original.count(base)
            skips = []
            while here and rng.random() < 0.8:
                skip = rng.randint(0, min(3, here - 1))
                skips.append(skip)
                here -= skip + 1
            groups.append(",".join([head, *map(str, skips)]))
            n_ml += len(skips) * (2 if "mh" in head else 1 if head != "q?" else 0)
    mm = ";".join(groups) + (";" if groups else "")
    ml = [rng.randint(0, 255) for _ in range(max(0, n_ml - rng.choice([0, 0, 2])))]
    return dict(tid=rng.choice([0, 1, -1]), left=rng.randint(0, 9000), bases=bases, cigar=cigar, flag=flag, mm=mm, ml=ml, nl=[rng.randint(0, 200) for _ in range(i % 3)], al=[7] * (i % 2))


def test_batches_equal_the_plain_decoder():
    rng = random.Random(12)
    given = [random_record(rng, i) for i in range(400)]
    body = [record(f"r{i}" * (1 + i % 3), **r) for i, r in enumerate(given)]
    for size in (1, 7, 400):
        for lo in range(0, len(given), size):
            data = b"".join(body[lo : lo + size])
            starts = np.cumsum([4, *(len(b) for b in body[lo : lo + size - 1])]) if size > 1 else np.array([4])
            starts = starts[: len(body[lo : lo + size])]
            rows = bam_batch.decode(data, starts, lo).to_pylist()
            for r, want in zip(rows, given[lo : lo + size], strict=True):
                calls, right = plain_calls(*[want[k] for k in ("tid", "left", "bases", "cigar", "flag", "mm", "ml")])
                assert [tuple(c.values()) for c in r["mods"]] == calls
                assert (r["tid"], r["qlen"], r["left0"], r["right1"], r["nuc_len"], r["msp_len"]) == (want["tid"], len(want["bases"]), want["left"], right, want["nl"], want["al"])
                assert r["read_id"] >= lo
            some = bam_batch.decode(data, starts, lo, ["msp_len", "tid"])
            assert some.schema.names == ["msp_len", "tid"] and some["tid"].to_pylist() == [r["tid"] for r in rows]
    with pytest.raises(ValueError):
        bam_batch.decode(record("x", 0, 1, "ACGT", mm="C+m,5;", ml=[1]), np.array([4]), 0)


# an index


def reg2bin(lo, hi):
    for base, shift in reversed(bam_index.LEVELS):
        if lo >> shift == (hi - 1) >> shift:
            return base + (lo >> shift)


def indexed(path, contigs, given, size=1500):
    """Write sorted records with an index; blocks of `size` unpacked bytes."""
    given = sorted(given, key=lambda r: (r["tid"] if r["tid"] >= 0 else 99, r["left"]))
    top = header(contigs)
    body = [record(f"r{i}", **r) for i, r in enumerate(given)]
    whole = pack(top + b"".join(body), size)
    blocks, at = [], 0
    while at < len(whole):
        blocks.append(at)
        at += struct.unpack_from("<H", whole, at + 16)[0] + 1
    virtual = lambda p: blocks[p // size] << 16 | p % size
    bins, linear, p = [{} for _ in contigs], [{} for _ in contigs], len(top)
    for r, b in zip(given, body, strict=True):
        if r["tid"] >= 0:
            end = max(r["left"] + 1, plain_calls(*[r[k] for k in ("tid", "left", "bases", "cigar", "flag", "mm", "ml")])[1])
            bins[r["tid"]].setdefault(reg2bin(r["left"], end), []).append((virtual(p), virtual(p + len(b))))
            for w in range(r["left"] >> 14, ((end - 1) >> 14) + 1):
                linear[r["tid"]].setdefault(w, virtual(p))
        p += len(b)
    out = b"BAI\x01" + struct.pack("<i", len(contigs))
    for mine, windows in zip(bins, linear, strict=True):
        mine[bam_index.METADATA] = [(0, 0), (1, 1)]
        out += struct.pack("<i", len(mine))
        for number, chunks in mine.items():
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        n, last = max(windows, default=-1) + 1, 0
        out += struct.pack("<i", n)
        for w in range(n):
            last = windows.get(w, last)
            out += struct.pack("<Q", last)
    path.write_bytes(whole)
    path.with_name(path.name + ".bai").write_bytes(out)
    return given, len(whole)


@pytest.fixture
def sorted_bam(tmp_path):
    rng = random.Random(5)
    given = [dict(random_record(rng, i), left=rng.randint(0, 400_000)) for i in range(900)]
    given += [dict(random_record(rng, 1), tid=0, left=50, bases="A" * 20, cigar=[(20, "M"), (200_000, "N")], mm="", ml=[])]  # it reaches over many windows
    (tmp_path / "s").mkdir()
    contigs = [("chr1", 10**6), ("chr2", 10**6)]
    return tmp_path / "s/x.bam", *indexed(tmp_path / "s/x.bam", contigs, given)


def brute(given, intervals):
    out = []
    for r in given:
        right = plain_calls(*[r[k] for k in ("tid", "left", "bases", "cigar", "flag", "mm", "ml")])[1]
        if any(r["tid"] == t and r["left"] < hi and max(right, r["left"] + 1) > lo for t, lo, hi in intervals):
            out.append((r["tid"], r["left"], right, len(r["bases"])))
    return sorted(out)


def test_intervals_read_what_they_touch(spark, sorted_bam, monkeypatch):
    path, given, size = sorted_bam
    reader = bam.BamSource({"path": str(path), "intervals": json.dumps([[0, 100_000, 100_100]])}).reader(bam.READS)
    parts = reader.partitions()
    assert sum((b >> 16) - (a >> 16) for p in parts for a, b in p.chunks) < size / 5
    opened = []
    real = bam._Blocks.more
    monkeypatch.setattr(bam._Blocks, "more", lambda self: (opened.append(self.next), real(self))[1])
    for p in parts:
        list(reader.read(p))
    assert len(set(opened)) < len(given) / 20  # of some hundred blocks
    monkeypatch.undo()
    for some in ([(0, 100_000, 100_100)], [(0, 0, 30), (1, 0, 10**6)], [(0, 16_384, 16_385), (0, 16_000, 17_000), (1, 399_000, 500_000)], [(1, 999_999, 10**6)], []):
        for width in (2000, 32 << 20):
            rows = bam.read_bam(spark, str(path), width, columns=["qlen", "left0", "tid", "right1", "read_id"], intervals=some).collect()
            assert sorted((r.tid, r.left0, r.right1, r.qlen) for r in rows) == brute(given, some)
            assert len({r.read_id for r in rows}) == len(rows)
    path.with_name("x.bam.bai").unlink()  # all of the file is read then, for the same records
    assert bam.read_bam(spark, str(path), intervals=[(0, 100_000, 100_100)]).count() == len(brute(given, [(0, 100_000, 100_100)]))


def test_filters_are_pushed(spark, sorted_bam):
    path, given, size = sorted_bam
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    conditions = ("tid = 0 and left0 < 50000 and right1 > 40000", "tid in (0, 1) and left0 <= 70 and right1 >= 60", "tid = 1 and left0 >= 390000", "tid = 0 and right1 < 2000", "tid = -1", "left0 < 10")
    want = {c: sorted(map(tuple, bam.read_bam(spark, str(path)).where(c).select("tid", "left0", "right1", "qlen").collect())) for c in conditions}
    assert sum(map(bool, want.values())) >= 4
    try:
        spark.conf.set(name, True)
        for c in conditions:
            df = bam.read_bam(spark, str(path), 3000).where(c)
            assert sorted(map(tuple, df.select("tid", "left0", "right1", "qlen").collect())) == want[c]
    finally:
        spark.conf.set(name, before)
    reader = bam.BamSource({"path": str(path), "pushFilters": "true"}).reader(bam.READS)
    kept = [bam.EqualTo(("tid",), 0), bam.LessThan(("left0",), 1000)]
    assert list(reader.pushFilters(kept)) == kept and reader.pushed == [(0, 0, 1001)]
    assert sum((b >> 16) - (a >> 16) for p in reader.partitions() for a, b in p.chunks) < size / 5


def test_profile_alone_reads_by_the_index(spark, sorted_bam, tmp_path, monkeypatch):
    import tidestat
    from tidestat.sources import bam as source

    path, given, size = sorted_bam
    (tmp_path / "r.csv").write_text("chrom,start,stop\nchr1,100000,100100\nchr2,200000,200020\n")
    conf = f"stats: [MetaPlot]\nconfigs: {{MetaPlot: [{{file: {tmp_path}/r.csv, label: L, width: 3000}}]}}\n"
    (tmp_path / "c.yaml").write_text(conf)
    seen = []
    real = source.read_bam
    monkeypatch.setattr(source, "read_bam", lambda *a, **k: (seen.append(k), real(*a, **k))[1])
    by_index = tidestat.run_bam(spark, str(path), str(tmp_path / "c.yaml"), str(tmp_path / "one"))
    assert seen[-1]["intervals"] and "nuc_len" not in seen[-1]["columns"]
    path.with_name("x.bam.bai").unlink()
    whole = tidestat.run_bam(spark, str(path), str(tmp_path / "c.yaml"), str(tmp_path / "two"))
    rows = [sorted(map(tuple, s.stats["MetaPlot"].collect())) for s in (by_index, whole)]
    assert rows[0] == rows[1] and sum(r[4] for r in rows[0]) > 0


def test_columns_of_a_run(spark, sorted_bam, tmp_path):
    import tidestat
    from tidestat.sources.config import StatConfig

    path, given, _ = sorted_bam
    saved = tidestat.run_bam(spark, str(path), StatConfig(("ChromStat", "ReadLengthCounter"), {}), str(tmp_path / "out"))
    assert saved.stats["ReadLengthCounter"].selectExpr("sum(count)").first()[0] == len(given)
