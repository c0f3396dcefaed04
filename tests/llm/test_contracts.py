"""The contracts' queries against brute force, on the smallest tables and on hand-made rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidestat.llm import audio, bloom, bpe, chat, components, decontaminate, html_extract, jaccard_join, licenses, line_dedup, placed, queries, substring_dedup, toxicity
from tidestat.llm.common import join_hot

DOC = "doc_id long, text string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def odd():
    """Rows with nulls, ties, repeats, long and empty texts, shared lines and passages."""
    rng = random.Random(7)
    word = lambda: rng.choice("the of and x y zz Éa ñu 日本 a'b 12 !! -".split())
    passage = " ".join(word() + str(i) for i in range(40))
    base = [" ".join(word() for _ in range(n)) for n in (0, 1, 2, 5, 19, 20, 21, 60, 200)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[7]), (21, base[7].upper()), (22, base[8] + " tail"), (23, "start " + base[8]), (24, None), (25, ""), (26, " \n\t \x0b\n"), (None, base[8]), (27, "word " * 70)]
    rows += [(30 + i, f"{word()} {passage} {word()}\nCommon Line Here\n  common line here \nshort\n" + " ".join(word() for _ in range(30))) for i in range(6)]
    rows += [(40, "long " * 5000 + "\nCommon Line Here"), (41, "a b c d e f g h i j " * 8), (7, base[7]), (42, "x" * 30_000), (43, "\x1c a\x85b c　d")]
    near = [f"w{i}" for i in range(300)]
    for i in range(8):
        copy = list(near)
        for j in range(i):
            copy[20 + 30 * j] = f"e{i}-{j}"
        rows.append((60 + i, " ".join(copy)))
    return rows


def frame(spark, rows):
    """rows with extra columns whose names clash with those of the operators."""
    extra = [(i, t, 1, "x", 2) for i, t in rows]
    return spark.createDataFrame(extra, DOC + ", n_lines int, tokens string, items int")


# line dedup


def brute_lines(rows):
    def key(line):
        k = low(line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 10 else None

    where = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if key(line):
                    where.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (key(x) and len(where[key(x)]) > 1 and min(where[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark, odd):
    out = line_dedup.dedup_lines(frame(spark, odd))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str) == brute_lines(odd)
    assert set(out.columns) == {"doc_id", "text", "n_lines", "n_dropped", "tokens", "items"}
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def _stored(spark, rows, path, files=3):
    """The rows in a Parquet table of some files and small row groups."""
    frame(spark, rows).repartition(files).write.option("parquet.block.size", 1 << 16).parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("chunk", [1, 3, 1 << 16])
def test_line_dedup_brings_drops_to_stored_texts(spark, odd, tmp_path, monkeypatch, chunk):
    """No exchange of texts where rows have places; the same rows out, columns of the same names and no others."""
    monkeypatch.setattr(placed, "CHUNK", chunk)
    rows = odd + [(100 + i, f"a line that repeats\nits own line {i}\nA line that repeats ") for i in range(40)]
    docs = _stored(spark, rows, tmp_path / "docs")
    for given in (docs, docs.where("doc_id is null or doc_id <> 105").withColumnRenamed("items", "__ROW")):
        out = line_dedup.dedup_lines(given)
        want = brute_lines([(i, t) for i, t in rows if given is docs or i != 105])
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str) == want
        assert set(out.columns) == {*given.columns, "n_lines", "n_dropped"}
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_joins_where_the_folder_is_not_seen(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(placed, "write", lambda facts, name: None)
    out = line_dedup.dedup_lines(_stored(spark, odd, tmp_path / "docs"))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str) == brute_lines(odd)


def test_rows_that_share_a_place(spark, tmp_path):
    """Rows made of one row of a table have its place; facts are told apart by document."""
    spark.createDataFrame([(i,) for i in range(6)], "k long").write.parquet(str(tmp_path / "k"))
    many = spark.read.parquet(str(tmp_path / "k")).selectExpr("explode(array(k, k + 10)) as doc_id", "k").selectExpr("doc_id", "concat('some shared line\nown line no ', doc_id) as text")
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(many).collect())
    ids = sorted([*range(6), *range(10, 16)])
    assert got == [(i, ("some shared line\n" if i == 0 else "") + f"own line no {i}") for i in ids]


def test_line_dedup_holds_few_texts(spark, odd):
    """Texts are read a few at a time and not sorted, whatever the session has."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        for given, want in (("4096", "256"), ("100", "100")):
            spark.conf.set(name, given)
            out = line_dedup.dedup_lines(frame(spark, odd))
            assert spark.conf.get(name) == want
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan.split("ShuffledHashJoin")[0]
    finally:
        spark.conf.set(name, before)


def full(*_):
    """A Bloom filter of far more hashes than bits: all pass."""
    return lambda h: np.ones(len(h), bool)


def test_line_dedup_with_a_full_filter(spark, odd, monkeypatch):
    monkeypatch.setattr(bloom, "repeated", full)
    out = line_dedup.dedup_lines(frame(spark, odd))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=str) == brute_lines(odd)


def test_bloom_pair_over_its_bits(spark, monkeypatch):
    """Fewer bits than hashes: more pass, none of the repeated ones is lost."""
    monkeypatch.setattr(bloom, "MAX_FILTER_BYTES", 1 << 17)
    df = spark.range(600_000).selectExpr("id % 590000 as h").repartition(4)
    numbers = lambda batches: (b.column(0).to_numpy().astype(np.uint64) for b in batches)
    test = bloom.repeated(df, numbers, 600_000)
    assert test(np.arange(10_000, dtype=np.uint64)).all() and test(np.arange(10_000, 590_000, dtype=np.uint64)).mean() < 0.9
    assert bloom.member(df, 600_000)(np.arange(590_000, dtype=np.uint64)).all()


def test_hot_keys_meet_where_they_are(spark):
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i % 50}", i) for i in range(100)], "key string, i int")
    right = left.groupBy("key").count().where("key != 'k7'")
    got = join_hot(left, right, ["key"], "count", left.count())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "key").collect()))


# decontamination


def brute_hits(rows, items, window=10):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or "")) if w]
    windows = {}
    for k, t in items:
        w = cut(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (k := windows.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    found |= k
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def test_decontamination(spark, odd, monkeypatch):
    passage = odd[20][1].split("\n")[0]
    items = [(1, passage), (2, "zz THE"), (3, ""), (4, None), (10, " ".join(passage.split()[5:25])), (2, "zz the"), (None, "word word word word"), (5, "a b c d e f g h i j a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(odd, items)
    out = decontaminate.find_hits(frame(spark, odd), bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect()), key=str)
    assert got == want
    monkeypatch.setattr(decontaminate, "MAX_WORDS", 30)  # several groups, one pass each
    out = decontaminate.find_hits(frame(spark, odd), bench)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect()), key=str) == want
    clean = decontaminate.decontaminate(frame(spark, odd), bench)
    assert clean.columns == ["doc_id", "text", "n_lines", "tokens", "items"]
    hits = {r[0] for r in want if r[2]}
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert all(kept[i] == t for i, t in odd if i not in hits and i is not None)
    assert all(x.n_hit == 0 for x in decontaminate.find_hits(spark.createDataFrame(list(kept.items()), DOC), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect())
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_hits(frame(spark, odd), none).agg(F.sum("n_hit")).first()[0] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton(items, doc):
    coded = [(str(i), [w.encode() for w in x]) for i, x in enumerate(items)]
    spans, found = decontaminate.SuffixAutomaton(coded, 4).scan([w.encode() for w in doc])
    want = brute_hits([(0, " ".join(doc))], [(i, " ".join(x)) for i, x in enumerate(items)], 4)[0]
    assert (sum(b - a for a, b in spans), sorted(found)) == (want[2], want[3])


# substring dedup


def brute_windows(rows, window=20):
    first = {}
    listed = [(i, words_of(t)) for i, t in rows]
    for i, w in listed:
        if i is not None:
            for j in range(len(w) - window + 1):
                k = tuple(w[j : j + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in listed:
        gone, own = set(), set()
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if k in own or i is not None and first[k] < i:
                gone.update(range(j, j + window))
            own.add(k)
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("filtered", [True, False])
def test_substring_dedup(spark, odd, monkeypatch, filtered):
    if not filtered:
        monkeypatch.setattr(bloom, "repeated", full)
    out = substring_dedup.dedup_substrings(frame(spark, odd))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=str) == brute_windows(odd)


def test_substring_dedup_brings_runs_to_stored_texts(spark, odd, tmp_path, monkeypatch):
    """No exchange of texts where rows have places, and the same rows out."""
    monkeypatch.setattr(placed, "CHUNK", 3)
    rng = random.Random(8)
    shared = [" ".join(f"s{i}w{j}" for j in range(30)) for i in range(5)]
    rows = odd + [(200 + i, f"own {i} " + " ".join(rng.sample(shared, 3)) + f" end {i}") for i in range(30)]
    docs = _stored(spark, rows, tmp_path / "docs")
    out = substring_dedup.dedup_substrings(docs)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=str) == brute_windows(rows)
    assert set(out.columns) == {*docs.columns, "n_words", "n_removed"}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_substring_dedup_of_few_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 80)))) for i in range(60)]
    rows += [(100 + i, "a " * (20 + i)) for i in range(4)]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOC), window=8)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect()), key=str) == brute_windows(rows, 8)
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], DOC)).count() == 0


# n-gram Jaccard join


def brute_components(rows, k=3, percent=90):
    def grams(t):
        w = words_of(low(t or ""))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    forest = components.Forest()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                forest.join(a, b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None and sets[a]:
            least[forest.find(a)] = min(least.get(forest.find(a), i), i)
    return sorted([(i, len(sets[a]), least.get(forest.find(a), i) if sets[a] else i) for a, (i, _) in enumerate(rows)], key=str)


@pytest.mark.parametrize("k,percent,block", [(3, 90, 2048), (5, 80, 3)])
def test_jaccard_components(spark, odd, monkeypatch, k, percent, block):
    if k == 5:
        monkeypatch.setattr(bloom, "member", full)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MEDIUM", 2)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 3)  # pairs of tokens, even here
    monkeypatch.setattr(jaccard_join, "CLASS_BITS", 1 << 20)
    out = jaccard_join.jaccard_components(frame(spark, odd), k, percent)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_components(odd, k, percent)
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    named = frame(spark, odd[:12]).withColumn("__GONE", F.lit(1))
    assert jaccard_join.dedup_documents(named).columns == named.columns


def test_jaccard_signatures_of_long_texts():
    """A text of 200,000 frequent tokens has signatures in proportion to it."""
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 200_000).astype(np.uint64))
    assert len(jaccard_join.signatures(x, np.full(len(x), 2), 90)) < 12 * len(x) * 0.1 + 1000


def test_jaccard_random_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "MEDIUM", 2)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    monkeypatch.setattr(jaccard_join, "CLASS_BITS", 1 << 20)
    rng = random.Random(5)
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randint(0, 60)}" for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(15):
            copy = [w if rng.random() > 0.02 else f"n{rng.randint(0, 9)}" for w in base]
            rows.append((len(rows) * 3 % 100, " ".join(copy[rng.randint(0, 2) :])))
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOC))
    got, want = Counter(tuple(r) for r in out.collect()), Counter(brute_components(rows))
    assert got == want


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 60) | st.integers(500, 4000), st.floats(0, 0.25), st.integers(0, 10**6), st.booleans(), st.integers(0, 2))
def test_linked_sets_share_a_signature(n, share, seed, least, kind):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 50 * n, n).astype(np.uint64))
    edits = int(n * share)
    gone = x[edits:] if least else rng.permutation(x)[edits:]  # the prefix, or anything
    y = np.unique(np.concatenate([gone, rng.integers(50 * n, 100 * n, int(edits * rng.random())).astype(np.uint64)]))
    inter = len(np.intersect1d(x, y))
    classes = lambda t: (t % np.uint64(3)).astype(int) if kind == 0 else np.full(len(t), kind)
    if min(len(x), len(y)) > 1 and 100 * inter >= 80 * (len(x) + len(y) - inter) and not np.array_equal(x, y):
        assert set(jaccard_join.signatures(x, classes(x), 80).tolist()) & set(jaccard_join.signatures(y, classes(y), 80).tolist())


def test_components_contract(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    out = components.components(spark.createDataFrame(edges, "a long, b long"), one_task=5)
    groups = {}
    for r in out.collect():
        groups.setdefault(r.root, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [list(range(41)), [100, 101, 102]]


# BPE


@pytest.fixture(scope="module")
def tok():
    return queries.tokenizer()


@pytest.fixture(scope="module")
def library(tok):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tok.pattern, mergeable_ranks=bpe.read_ranks(tok.path), special_tokens={})


@pytest.mark.parametrize("most", [0, 20, bpe.MAX_WORDS])
def test_bpe(spark, odd, tok, library, most):
    rng = random.Random(4)
    rows = odd + [(83, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))), (84, "".join(rng.choices(["the", "er", "ing", "tion"], k=2_000)))]
    rows += [(85, "-" * 997 + "=" * 500), (86, "日本語のテキスト" * 300), (87, "ab" * 500 + "aba" * 301), (88, "".join(rng.choices("ab", k=1_000)))]
    rows += [(80, "<|endoftext|> it's 'RE  \n\n x"), (81, "²½ ١٢ á 👩‍👩‍👧 ​"), (82, "q" * 300)]
    out = bpe.encode(frame(spark, rows), tok, most=most)
    back = bpe.decode(out, tok)
    got = sorted(((r.doc_id, list(r.tokens), bytes(r.decoded)) for r in back.collect()), key=str)
    assert got == sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert {"__ids", "__GAPS"} <= set(bpe.encode(frame(spark, rows[:3]).withColumn("__ids", F.lit(1)).withColumn("__GAPS", F.lit(2)), tok).columns)
    assert bpe.encode(frame(spark, []), tok).count() == 0


@given(st.lists(st.text(st.sampled_from("abcdehinorst'Aé日"), min_size=20, max_size=200), min_size=20, max_size=20))
@settings(max_examples=5, deadline=None)
def test_bpe_long_words(spark, tok, library, texts):
    out = bpe.encode(spark.createDataFrame(list(enumerate(texts)), DOC), tok)
    assert {r.doc_id: list(r.tokens) for r in out.collect()} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r'stremvld1²é\x1c\x85\xa0\u2003日")), max_size=60))
@settings(max_examples=500, deadline=None)
def test_bpe_pattern(tok, text):
    assert bpe.Splitter(tok).find()(text.encode()) == regex.findall(tok.pattern, text)


def test_bpe_pattern_classes(tok):
    find, plain = bpe.Splitter(tok).find(), bpe.plain_pattern(tok.pattern)
    for c in map(chr, range(bpe._PLAIN + 100)):
        text = f"a{c}b {c}{c} 1{c} '{c}s \n{c}\n "
        assert find(text.encode()) == regex.findall(tok.pattern, text)
    assert plain is not None
    assert all(bpe.plain_pattern(p) is None for p in (r"\p{Lu}+", r"(?i:'s)", r"\w", r"[a-z]", r"[^\S]"))


def test_op3(spark, small, library):
    texts = dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op3_byte_bpe(spark, small).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r.doc_id] or ""))


# chat


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "### User: \\ </turn>\n"), (1, 0, "user", "a\\"), (1, 0, "user", "a\\"), (2, None, None, None), (2, 0, "we)ird \\( role", ") </turn>"), (None, 0, "user", "x")]
    rows += [(3, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(9)]
    segments = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == want
    assert got[3].valid and not got[1].valid and not got[2].valid
    whole = "".join(r.segment for r in segments.where("conv_id = 1").orderBy("place").collect())
    assert len(whole) == got[1].formatted_chars and whole.count("### ") - whole.count("\\### ") == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x)y", ""]), st.text(alphabet="#\\</turn>) \nRole(:a", max_size=30)), max_size=5))
def test_chat_reader(turns):
    t, reader, got = chat.DEFAULT, chat.Reader(), []
    for role, text in turns:
        for piece in (t.header.format(label=t.label(role)), t.escape(text), t.close):
            got += list(reader.feed(piece))
    assert got == turns and not reader.buffer


# pages


def test_html_cases():
    main = html_extract.main_text
    body = "<p>" + "Main text of some length. " * 6 + "</p>"
    assert main(None) == main("") == main("<html><script>var x='<p>no</p>'</script></html>") == ""
    page = f"<html><head><title>T</title></head><body><header>Top</header><nav><a href=/>Home</a></nav><div class='sidebar'>Side</div><article><h1>Head &amp; more</h1>{body}<div class=\"ad\">Buy</div><p>a<br>b  <b>c</b>\n d</p><form>Mail<input></form></article><section id='comments'><article class='comment'>{body}</article></section><footer>F</footer></body>"
    assert main(page) == "Head & more\n" + ("Main text of some length. " * 6).strip() + "\na b c d"
    assert main(f"<div><div id='cookie-banner'>Cookies</div><div>{body}<p>Tail</p></div></div>").endswith("\nTail")
    assert main("<p>tiny") == "tiny" and main("a < b & c") == "a < b & c"
    assert main("<article><p>x" + "<!-- c --><p class=notice>no</p>" + "<p>y</article>") == "x\ny"


def test_html_surge_and_dive_inside_an_article():
    long = "This sentence is long enough to reach the threshold of a window of lines, with many words of text. " * 2
    links = "<div><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></div>"
    ad = "<div class=ad>Buy</div>"
    page = f"<article>{links}{ad}<section><p>{long}</p>{ad}<p>Short but inside.</p></section>{ad}{links}</article><article><p>Small article.</p></article>"
    assert html_extract.main_text(page) == "\n".join([long.strip(), "Short but inside.", "Small article."])


def _unmarked() -> str:
    """A page without a telling name: a list of links, an article, more links, a line of text after them."""
    long = "This sentence is long enough to reach the threshold of a window of lines, with many words of text. " * 2
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>Other page {i}</a></li>" for i in range(5)) + "</ul></div>"
    return f"<body>{links}<div><h2>A heading</h2><p>{long}</p><p>Short.</p><p>{long}</p><p>The end.</p></div>{links}<div>Some rights reserved</div></body>"


def test_html_windows_cut_pages_without_names():
    long = ("This sentence is long enough to reach the threshold of a window of lines, with many words of text. " * 2).strip()
    assert html_extract.main_text(_unmarked()) == "\n".join(["A heading", long, "Short.", long, "The end."])
    links = "<ul>" + "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(4)) + "</ul>"
    page = f"<article><h1>Title</h1><p>{long}</p><p>End.</p>{links}<p>Share this page with friends</p></article>"
    assert html_extract.main_text(page) == f"Title\n{long}\nEnd."
    assert html_extract.main_text(f"<article><p>{long}</p><aside>{'<p>Aside.</p>' * 6}</aside><p>On.</p><p>{long}</p></article>") == f"{long}\nOn.\n{long}"


def test_html_window_sums_decide(small, monkeypatch):
    """With one sum for all windows nothing surges or dives, and results are others, on pages with telling names and without."""
    import duckdb

    pages = [r[0] for r in duckdb.sql(f"SELECT html FROM '{small}/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    want = [html_extract.main_text(p) for p in pages]
    unmarked = html_extract.main_text(_unmarked())
    monkeypatch.setattr(html_extract, "window_sums", lambda weights, window=3: [100.0] * len(weights))
    assert html_extract.main_text(_unmarked()) != unmarked
    assert sum(html_extract.main_text(p) != w for p, w in zip(pages, want, strict=True)) > len(pages) / 2


def test_op1_extracts_the_articles(spark, small):
    import html

    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op1_html_extraction(spark, small).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id].html or "", re.S)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner[1])] if inner else []
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


# toxicity


def test_toxicity_held_out():
    rng = random.Random(2)
    plain = [f"w{i}ing" for i in range(400)]
    rows = []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 200))]
        y = int(i % 4 == 0)
        for _ in range(4 * y):
            w.insert(rng.randint(0, len(w)), rng.choice(["grumblefoo", "snarkwitted", "blasterous"]))
        rows.append((" ".join(w), y))
    model = toxicity.fit(rows[:400])
    s = toxicity.Scorer(model).scores(t for t, _ in rows[400:])
    y = np.array([y for _, y in rows[400:]])
    assert ((s >= 0.7) == (y == 1)).mean() > 0.97
    assert toxicity.fit([]).weights and toxicity.Scorer(toxicity.fit([("a", 0)])).scores(["x"])[0] < 0.1


def test_toxicity_drops_near_copies_only():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(["of the", *rng.choices(words, k=60), "of the"]) for _ in range(200)]  # all share a word pair
    rows = [(t, i % 2) for i, t in enumerate(texts)]
    copies = [(f"{t} end", y) for t, y in rows[:50]] + [("", 0), ("", 0), ("one", 0), ("one", 0), ("two", 0)]
    kept = toxicity._distinct(rows + copies)
    assert kept == [(toxicity.plain(t), y) for t, y in rows + [("", 0), ("one", 0), ("two", 0)]]


@pytest.mark.parametrize("text", ["", "a", "Ab cd\n ef", "x" * 100, "word " * 50, "ä-ö ñ"])
def test_toxicity_windows(text):
    words = toxicity.words_of(text)
    made = toxicity.windows(words)
    assert [w for x in made for w in x.split()] == words
    assert all(len(x) <= toxicity.WINDOW_BYTES + 1 or len(x.split()) == 1 for x in made)


def test_toxicity_dictionaries_are_of_their_class():
    rng = random.Random(3)
    slurs = [f"{chr(97 + i)}grumblesnark" for i in range(20)]
    plain = [f"plainword{i}" for i in range(100)]
    rows = [(" ".join([*rng.sample(plain, 20), *rng.sample(slurs, 4), *rng.sample(plain, 20)]), 1) for _ in range(200)]
    rows += [(" ".join(rng.sample(plain, 40)), 0) for _ in range(400)]
    model = toxicity.fit(rows)
    assert b"grumblesnark" in model.toxic and b"snark" not in model.ordinary and b"plainword" in model.ordinary
    assert all(b"plainword" not in x for x in toxicity.own_stretches([toxicity.plain(t) for t, y in rows if y], [toxicity.plain(t) for t, y in rows if not y])[:1])
    s = toxicity.Scorer(model)
    a, b = s.margins([b" agrumblesnark plainword1 ", b" plainword1 plainword2 "])
    assert a > 2 and b <= 1


def test_toxicity_on_held_out_rows_of_the_tables():
    """As good on rows that it has not seen as the README says."""
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    rows = duckdb.sql(f"select doc_id, coalesce(text, ''), toxic from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) where toxic is not null order by 1").fetchall()
    out = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    model = toxicity.fit([r[1:] for r, o in zip(rows, out, strict=True) if not o])
    test = [r[1:] for r, o in zip(rows, out, strict=True) if o]
    s, y = toxicity.Scorer(model).scores(t for t, _ in test), np.array([y for _, y in test])
    rank = s.argsort().argsort()
    assert (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum()) > 0.93  # area under the curve
    assert (s[y == 1] >= 0.7).mean() > 0.55 and (s[y == 0] < 0.7).mean() > 0.985 and y[s >= 0.7].mean() > 0.85


def test_toxicity_passes_over_a_long_row(spark):
    texts = [(i, ("slur " if i % 2 else "fair ") + f"a{i} b{i} c{i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, toxic int")
    order = [r.doc_id for r in labels.selectExpr("doc_id", "xxhash64(doc_id) h").orderBy("h").collect()]
    rows = [(i, "x " * 9000 if i == order[0] else t) for i, t in texts] + [(40, "x " * 9000 if order[0] == 40 else "y")]
    model = toxicity.train(frame(spark, rows), labels, "false", max_bytes=9000)
    assert model.ordinary  # the others were learned from
    with pytest.raises(ValueError, match="fits"):
        toxicity.train(frame(spark, rows), labels, "false", max_bytes=0)


def test_op4(spark, small):
    out = queries.op4_toxicity(spark, small)
    rows = out.collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_odd_rows(spark, odd):
    model = toxicity.train(frame(spark, odd), spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (999, 1)], "doc_id long, toxic int"), "false")
    assert toxicity.score(frame(spark, odd), model).where("score between 0 and 1").count() == len(odd)
    assert toxicity.score(frame(spark, []), model).count() == 0
    assert toxicity.train(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"), "false").bias == 0


# licences


def test_licenses(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;")), (3, mit + " extra"), (4, None), (5, ""), (6, "text\n  licensed under the MIT licence.\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: (r.license, list(r.notices)) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: ("MIT", []), 2: ("MIT", []), 3: (None, []), 4: (None, []), 5: (None, []), 6: (None, ["CC-BY-NC-4.0", "MIT"])}
    assert licenses.scan(frame(spark, [])).count() == 0
    long = " ".join(f"w{i}" for i in range(300))  # a notice may be of any length
    assert licenses.scan(frame(spark, [(1, f"a\n{long.upper()}!\nb")]), notices=(("own", long),)).first().notices == ["own"]
    clash = frame(spark, rows).withColumn("__FORM", F.lit(1)).withColumn("Digest", F.lit(2))
    assert licenses.scan(clash).columns == [*frame(spark, rows).columns, "__FORM", "digest", "license", "notices"]
    plan = licenses.scan(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_licences_by_digest(spark):
    """Planted whole texts, spelt otherwise and with another holder."""
    d = "/usr/share/common-licenses"
    if not os.path.isdir(d):
        pytest.skip("needs the licence texts")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
    rows, want = [], {}
    for i, (name, k) in enumerate(sorted(files.items())):
        with open(f"{d}/{name}") as f:
            t = f.read()
        for j, x in enumerate((t, "Copyright 2024 A. Holder\n" + t.replace("license", "licence").replace(",", " , "), t.replace(" ", "  ").replace("\n    ", "\n\t "), t + " more")):
            rows.append((10 * i + j, x))
            want[10 * i + j] = None if j == 3 else k
    assert {r.doc_id: r.license for r in licenses.scan(frame(spark, rows)).collect()} == want


# audio


def test_audio_alignment_and_recall(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 64))
    rows = [(100 * i, b.tolist()) for i, b in enumerate(base)]
    rows += [(100 * i + 1, (b + rng.normal(scale=0.02, size=64)).tolist()) for i, b in enumerate(base)]
    rows += [(100 * i + 2, [*rng.normal(size=6).tolist(), *b[:58].tolist()]) for i, b in enumerate(base)]
    rows += [(9999, None), (9998, []), (None, base[0].tolist())]
    media = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = audio.fingerprints(media, "embedding", audio.render).cache()
    out = audio.search(found, found.where("vec_id % 100 = 0"), "vec_id", block=5)
    got = {(r.query_id, r.id): r for r in out.collect()}
    words = {r.vec_id: np.array(r.fingerprint, np.int32).view(np.uint32) for r in found.collect() if r.fingerprint and r.vec_id is not None}

    def brute(a, b):
        errors = [1.0]
        for off in range(-len(a), len(b)):
            lo, hi = max(0, -off), min(len(a), len(b) - off)
            if hi - lo >= audio.MIN_OVERLAP:
                errors.append(np.bitwise_count(a[lo:hi] ^ b[lo + off : hi + off]).sum() / (32 * (hi - lo)))
        return min(errors)

    want = {(q, i) for q in words if q % 100 == 0 for i in words if i != q and brute(words[q], words[i]) <= 0.2}
    assert len(want) >= 20 and len(want & got.keys()) >= 0.9 * len(want)
    assert all(got[100 * i, 100 * i + 2].offset == -6 for i in range(12) if (100 * i, 100 * i + 2) in got)  # the recording starts later
    assert audio.samples_of(b"junk").size == 0 and audio.fingerprint(np.zeros(100)).size == 0


def test_audio_limit_grows_with_the_overlap():
    """What may differ over 16, 32, 46, 78 and 256 words."""
    assert np.round(audio.limit(np.array([16, 32, 46, 78, 256])), 3).tolist() == [0.058, 0.188, 0.239, 0.3, 0.3]


def brute_alignments(words):
    """(query, recording) of all that align at the operator's limit, over all offsets of all pairs."""
    ids, table = np.array(list(words)), np.array(list(words.values()))  # all of one length
    n, want = table.shape[1], set()
    for q in ids[ids % 100 == 0]:
        a = words[q]
        for off in range(audio.MIN_OVERLAP - n, n - audio.MIN_OVERLAP + 1):
            lo, hi = max(0, -off), min(n, n - off)
            error = np.bitwise_count(a[lo:hi] ^ table[:, lo + off : hi + off]).sum(1) / (32 * (hi - lo))
            want |= {(int(q), int(i)) for i in ids[error <= 0.5 - 10 / np.sqrt(32 * (hi - lo))] if i != q}
    return want


def recall(spark, d):
    words = {r.vec_id: audio.fingerprint(audio.render(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    want = brute_alignments(words)
    rows = queries.op8_media_fingerprints(spark, d).collect()
    assert len(rows) == len(words) and all(r.query_ids == [m.query_id for m in r.matches] for r in rows)
    got = {(q, r.vec_id) for r in rows for q in r.query_ids}
    assert len(want) > 20 and got <= want and len(got) >= 0.9 * len(want)
    return want


def test_op8(spark):
    """The query over a whole table that holds copies, at the query's own limit."""
    d = "/root/testdata/check_s"
    if not os.path.isdir(d):
        pytest.skip("needs the test tables")
    recall(spark, d)


def test_op8_recall_over_planted_copies(spark, small, tmp_path):
    """The given vectors and copies of them: noisy ones, and ones that begin later; every copy is a query."""
    rng = np.random.default_rng(21)
    base = [(r.vec_id, np.array(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows = [(i, v.tolist()) for i, v in base]
    for j, (i, v) in enumerate(base[1:80]):
        cut = int(rng.integers(0, 20)) if j % 2 else 0
        noise = rng.normal(scale=v.std() * (0.02, 0.1, 0.2)[j % 3], size=64)
        rows.append((100_000 + 100 * j, [*rng.choice(v, cut).tolist(), *(v + noise)[: 64 - cut].tolist()]))
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = recall(spark, str(tmp_path))
    assert len({q for q, _ in want if q >= 100_000}) > 50


@pytest.mark.parametrize("dense", [0, 8, 10**9])
def test_audio_slices_change_nothing(monkeypatch, dense):
    rng = np.random.default_rng(5)
    queries_ = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (30, 80, 500)]
    long = np.concatenate([rng.integers(0, 1 << 32, 700, dtype=np.uint32), queries_[1], rng.integers(0, 1 << 32, 300, dtype=np.uint32), queries_[2][100:400]])
    monkeypatch.setattr(audio, "DENSE", dense)
    want = [x.tolist() for x in audio.Index([1, 2, 3], queries_).match(long, None)]
    assert want[0] == [2, 3]
    for most in (1, 7, 100):
        monkeypatch.setattr(audio, "POSTINGS", most)
        assert [x.tolist() for x in audio.Index([1, 2, 3], queries_).match(long, None)] == want


def test_audio_blocks_of_words(spark):
    """Long queries make more blocks, with the same matches."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(0, 1 << 31, 200).tolist()) for i in range(12)] + [(100, None)]
    rows += [(20 + i, rows[i][1][50:]) for i in range(12)]
    found = spark.createDataFrame(rows, "vec_id long, fingerprint array<int>")
    want = sorted(map(tuple, audio.search(found, found, "vec_id").collect()))
    out = audio.align(found, found, "vec_id", words=500)
    assert out.agg(F.max("block")).first()[0] >= 5
    assert sorted((m.query_id, r.id, m.offset, m.bit_error, m.votes) for r in out.collect() for m in r.matches) == want and len(want) >= 24


def test_op8_finds_planted_copies(spark, tmp_path):
    """Recordings cut from, and noisier than, others in a table of the query's own layout."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 64))
    rows = [(i, b.tolist()) for i, b in enumerate(base)]
    rows += [(100, base[3].tolist()), (200, (base[4] + rng.normal(scale=0.02, size=64)).tolist()), (300, [*rng.normal(size=5).tolist(), *base[5][:59].tolist()])]
    rows += [(400, None), (500, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = queries.op8_media_fingerprints(spark, str(tmp_path)).collect()
    assert len(rows) == 35
    got = {(m.query_id, r.vec_id): m.offset for r in rows for m in r.matches}
    assert got.keys() >= {(100, 3), (200, 4), (300, 5)} and got[100, 3] == 0 and got[300, 5] == 5
    assert all(i in (3, 4, 5, 100, 200, 300) for _, i in got)


def test_audio_short_and_noisy(spark):
    """Fixed limits: 16 words of overlap or more, 0.245 of bits in error over 48 words, and whole copies of any length."""
    rng = np.random.default_rng(9)
    word = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    a, b, c, d = word(60), word(18), word(48), word(5)
    tail = np.concatenate([a[-17:], word(30)])  # 17 words in common
    noisy = c.copy()
    noisy[:18] ^= np.uint32(0xFFFF0000)
    noisy[18:24] ^= np.uint32(0x00003FFF)  # 0.242 of all bits differ
    rows = [(0, a), (1, tail), (2, b), (3, b), (4, c), (5, noisy), (6, d), (7, d)]
    found = spark.createDataFrame([(i, w.view(np.int32).tolist()) for i, w in rows], "vec_id long, fingerprint array<int>")
    got = {(r.query_id, r.id) for r in audio.search(found, found, "vec_id").collect()}
    assert got >= {(0, 1), (1, 0), (2, 3), (3, 2), (4, 5), (5, 4), (6, 7), (7, 6)}


def test_audio_all_links_and_offsets(spark):
    """Every copy is linked, and the true offset is found behind three with more votes."""
    rng = np.random.default_rng(11)
    word = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    a, q = word(40), word(60)
    r = word(60)
    r[7:43] = q[:36] ^ np.uint32(0x01010100)  # 0.094 of the bits in error from offset 7 on, but few equal half-words
    r[7:12] = q[:5]
    for k, off in enumerate((20, 24, 28)):  # equal half-words at other offsets
        r[44 + 5 * k : 49 + 5 * k] = q[44 + 5 * k - off : 49 + 5 * k - off] & np.uint32(0xFFFF) | r[44 + 5 * k : 49 + 5 * k] & np.uint32(0xFFFF0000)
    rows = [*((i, a) for i in range(40)), (100, q), (101, r)]
    found = spark.createDataFrame([(i, w.view(np.int32).tolist()) for i, w in rows], "vec_id long, fingerprint array<int>")
    all_ = audio.search(found, found, "vec_id").cache()
    got = {(x.query_id, x.id): x for x in all_.collect()}
    assert {k for k in got if max(k) < 100} == {(i, j) for i in range(40) for j in range(40) if i != j}
    assert got[100, 101].offset == -7
    assert audio.best(all_).where("query_id = 3").count() == 10

    # Many votes at three wrong offsets, two at the true one.
    index = audio.Index([1], [q])
    wrong = np.concatenate([q[:40] ^ np.uint32(0x01010101), word(60)])
    wrong[:2] = q[:2] ^ np.uint32(0x01010000)
    for k, off in enumerate((20, 30, 40)):
        wrong[60 + 6 * k : 66 + 6 * k] = q[60 + 6 * k - off : 66 + 6 * k - off]
    assert [x.tolist() for x in index.match(wrong, None)[:2]] == [[1], [0]]


def plain_match(index_words, words):
    """All offsets of all recordings: those of two votes or more, each recording at its least error, and the words of overlap."""
    out, overlap = {}, 0
    parts = lambda w: [(w >> np.uint32(s)) & np.uint32(1023) for s in audio.PARTS]
    for i, w in enumerate(index_words):
        for off in range(1 - len(words), len(w)):
            lo, hi = max(0, -off), min(len(words), len(w) - off)
            x, y = words[lo:hi], w[lo + off : hi + off]
            votes = sum(int((p == q).sum()) for p, q in zip(parts(x), parts(y), strict=True))
            whole = off == 0 and hi == len(words) == len(w)
            if votes > 1 and (hi - lo >= audio.MIN_OVERLAP or whole):
                overlap += hi - lo
                error = int(np.bitwise_count(x ^ y).sum()) / (32 * (hi - lo))
                if error <= (audio.limit(np.array(hi - lo)) if hi - lo >= audio.MIN_OVERLAP else 0):
                    out[i] = min(out.get(i, (2.0,)), (error, -votes, off))
    return [(i, off, error, -votes) for i, (error, votes, off) in sorted(out.items())], overlap


@pytest.mark.parametrize("dense", [0, 8, 1 << 40])
def test_audio_drops_chance_early(monkeypatch, dense):
    """The same alignments as by whole overlaps, while unrelated recordings are compared over a part of theirs."""
    monkeypatch.setattr(audio, "DENSE", dense, raising=False)
    rng = np.random.default_rng(12)
    word = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    noise = lambda n: word(n) & word(n) & word(n)  # noqa: E731  an eighth of the bits
    words = word(46)
    known = [word(46) for _ in range(100)] + [words, words[:30], words[20:], word(5), word(0)]
    known += [words ^ noise(46), np.concatenate([word(9), words[:37] ^ noise(37)]), np.concatenate([words[-40:] ^ noise(40), word(60)])]
    compared, count = [], np.bitwise_count
    index = audio.Index(list(range(len(known))), known)
    for own in (words, known[3], known[-1], known[103], word(200)):
        want, overlap = plain_match(known, own)
        compared.clear()
        with monkeypatch.context() as m:
            m.setattr(np, "bitwise_count", lambda x: compared.append(x.nbytes // 4) or count(x))
            got = list(zip(*(x.tolist() for x in index.match(own, None)), strict=True))
        assert got == want
        assert len(own) != 46 or sum(compared) < 0.9 * overlap


def test_audio_reads_wav(tmp_path):
    import io
    import wave

    x = (audio.render(list(range(40))) * 9000).astype("<i2")
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(audio.RATE)
        w.writeframes(x.tobytes())
    assert np.array_equal(audio.fingerprint(audio.samples_of(f.getvalue())), audio.fingerprint(x / 32768))


# queries with SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, small, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    df = queries.QUERIES[name](spark, small)
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = lambda rows, names: sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rows), key=str)
    assert order(df.collect(), df.columns) == order(want.fetchall(), columns)


def test_decontaminate_names_in_any_case(spark, odd):
    docs = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in odd], DOC + ", N_words int, Spans string, ITEMS int")
    bench = spark.createDataFrame([(1, odd[20][1].split("\n")[0])], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    assert out.columns == docs.columns and out.where("N_words = 1 and Spans = 's' and ITEMS = 2").count() == out.count() > 0
    assert decontaminate.find_hits(docs, bench).agg(F.sum("n_hit")).first()[0] > 0
    assert decontaminate.find_hits(docs.where("false"), bench).count() == 0


def test_pipeline(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, small).cache()
        assert docs.columns == before.columns
        a, b = ({r.doc_id: r.text for r in x.collect()} for x in (before, docs))
        assert b.keys() <= a.keys() and b
        if name == "line dedup":
            want = {i: t for i, _, _, t in brute_lines(list(a.items()))}
            assert b == want
        if name == "n-gram Jaccard join":
            keep = {i for i, _, c in brute_components(list(a.items()), 5, 80) if i == c}
            assert b.keys() == keep
        if name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            hit = {i for i, _, n, _ in brute_hits(list(a.items()), items) if n}
            assert all(b[i] == a[i] for i in a if i not in hit)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    last = tokens.collect()
    for r in last:
        assert list(r.tokens) == library.encode_ordinary(r.text or "")
    whole = corpus_pipeline.run(spark, small)
    assert whole.columns == tokens.columns
    key = lambda r: (r.doc_id, r.text, r.n_tokens, r.ids_sha256)
    assert sorted(map(key, whole.collect())) == sorted(map(key, last))
