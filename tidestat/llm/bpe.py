"""Byte-level BPE encoding and decoding by a public rank file.

The merges of a word are folded by Spark higher-order functions over its byte array, with the ranks of pairs as literal
arrays (a perfect hash, so a lookup takes constant time; a scalar subquery reads them once an execution, which keeps them out of
plans). Words that repeat are folded once, most frequent first, up to MAX_WORDS, all in parallel; their ids are broadcast as a packed table. A
word outside it is folded in its document's row, once for each document: results do not depend on the table.

A word of over LONG bytes is first cut wherever its two bytes stand side by side in no token, so that no merge can cross. What
is still long merges all its pairs of least rank at once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from tidestat.llm.common import fresh, map_rows, materialise, raw, release, stored, tidy

#: Distinct words in the broadcast table (about 20 bytes each). A word of one place costs less there than in its row.
MAX_WORDS = 1_000_000
#: Bytes from which a word is cut, and its equal pairs merge together.
LONG = 48
#: Words that a task holds while it counts, and while it encodes.
_HELD, _CACHED = 100_000, 200_000
#: Characters split into words at a time.
_SLICE = 500_000
_GAP = b"\xff\xff\xff\xff"
#: Ids and ranks are below it; as a rank it means none.
_IDS = 1 << 22
#: Places in a word that is not long.
_PLACES = 64
#: Characters below it are matched by explicit classes.
_PLAIN = 0x3000


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (read by the driver)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """(rank, rank) -> rank of the joined bytes, for every way to cut a token in two tokens."""
    out = {}
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = r
    return out


class PairTable:
    """Pairs as a table of displaced rows: the pair (a, b) lies at slot base[a] + column[b], where owner is a."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        rows: dict[int, list[int]] = {}
        often = Counter(b for _, b in pairs)
        width = len(often) + 1
        self.column = [len(often)] * (max(often, default=0) + 1)  # one past the last for ids that end no pair
        for i, b in enumerate(sorted(often, key=lambda b: (-often[b], b))):
            self.column[b] = i
        for a, b in pairs:
            rows.setdefault(a, []).append(self.column[b])
        free = np.ones(2 * len(pairs) + 2 * width + 4096, bool)
        self.base = [0] * (max(rows, default=0) + 1)
        first = 0
        for a, columns in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            c = np.sort(np.array(columns))
            while not free[first]:
                first += 1
            at = max(0, first - int(c[0]))  # the row's first column meets no slot before `first`
            while True:
                fits = free[at + c[0] : at + c[0] + 4096].copy()
                for x in c[1:]:
                    part = free[at + x : at + x + 4096]
                    fits[: len(part)] &= part
                    fits[len(part) :] = False
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += 4096
                if at + width + 4096 > len(free):
                    free = np.concatenate([free, np.ones(len(free), bool)])
            free[at + c] = False
            self.base[a] = at
        size = int(np.flatnonzero(~free).max(initial=0)) + width + 1
        self.cell = [-1] * size  # owner and rank
        for (a, b), r in pairs.items():
            self.cell[self.base[a] + self.column[b]] = a * _IDS + r

    @staticmethod
    def lookup(a: str, b: str) -> str:
        """SQL: the rank of a pair of ids (bigint), or _IDS. Another's cell is, less its row, negative or large; none is null."""
        return f"least((get(_t.cell, get(_t.base, {a}) + get(_t.column, {b})) - {a} * {_IDS}L) & {(1 << 63) - 1}L, {_IDS}L)"


class Tokenizer:
    """A rank file as Spark expressions. ``pattern`` splits text before the merges."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        ranks = read_ranks(path)
        self.pieces = {r: t for t, r in ranks.items()}
        if max(self.pieces) >= _IDS:
            raise ValueError(f"ranks must be below {_IDS}")
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs = PairTable(pair_ranks(ranks))
        release()

        inside = np.zeros((256, 256), bool)  # byte pairs that some token holds
        for t in ranks:
            at = np.frombuffer(t, np.uint8)
            inside[at[:-1], at[1:]] = True
        self.inside = inside

    def tables(self, spark: SparkSession) -> str:
        """SQL: the tables as one struct, a scalar subquery over the one row of a written file (about 2 MB)."""
        table = self.pairs
        parts = {"base": table.base, "column": table.column, "cell": table.cell, "single": self.single}
        row = pa.table({k: pa.array([v], pa.list_(pa.int64() if k == "cell" else pa.int32())) for k, v in parts.items()})
        path = stored(spark.createDataFrame(row), "ranks")
        return f"(select struct({', '.join(parts)}) from parquet.`{path}`)"

    def fold_sql(self, word: str) -> str:
        """SQL: array<int> ids of a string.

        The state is an array of (rank of the pair that starts here, place of its first byte, id) as one number each. Places stay as
        they are, so the least number is the leftmost pair of least rank; a step merges it and looks up the two pairs that this makes.
        """
        look = self.pairs.lookup
        ids = f"transform(split(decode(encode({word}, 'UTF-8'), 'ISO-8859-1'), ''), _c -> get(_t.single, ascii(_c)))"
        ident = lambda x: f"int({x} & {_IDS - 1}L)"
        placed = lambda r, e, i: f"({r} * {_PLACES * _IDS}L + ({e} & {(_PLACES - 1) * _IDS}L) + {i})"
        first = f"transform(_i, (_x, _k) -> ({look('_x', 'get(_i, _k + 1)')} * {_PLACES} + _k) * {_IDS}L + _x)"
        start = f"transform(array({ids}), _i -> {first})[0]"
        before = placed(look(ident("_e"), "_m"), "_e", ident("_e"))
        merged = placed(look("_m", ident("get(_a, _p + 1)")), "_v", "_m")
        step = f"""concat(slice(_a, 1, greatest(_p - 2, 0)), transform(slice(_a, greatest(_p - 1, 1), if(_p > 1, 1, 0)), _e -> {before}),
            array({merged}), slice(_a, _p + 2, size(_a)))"""
        least = f"""transform(array(array_min(_a)), _v -> if(_v >= {_IDS * _PLACES * _IDS}L, _a,
            transform(array(int(array_position(_a, _v))), _p -> transform(array(int(shiftright(_v, 28))), _m -> {step})[0])[0]))[0]"""
        folded = f"aggregate(sequence(1, octet_length({word})), {start}, (_a, _n) -> {least}, _a -> transform(_a, _e -> {ident('_e')}))"
        # A long word, without places: of a run of equal pairs every second one merges, from the left ('11' becomes '10'); the state ends with a flag.
        rank = lambda x: f"shiftright({x}, 22)"
        paired = lambda a: f"transform({a}, (_x, _k) -> {look('_x', f'get({a}, _k + 1)')} * {_IDS}L + _x)"
        start = f"transform(array({ids}), _i -> {paired('_i')})[0]"
        flags = f"split(regexp_replace(array_join(transform(_s.a, _e -> if({rank('_e')} = _r, '1', '0')), ''), '11', '10'), '')"
        joined = f"""filter(transform(_s.a, (_e, _j) -> if(get(_f, _j) = '1', int(_r), if(_j > 0 and get(_f, _j - 1) = '1', -1, {ident('_e')}))), _x -> _x >= 0)"""
        many = f"""if(_s.d, _s, transform(array({rank('array_min(_s.a)')}), _r -> if(_r >= {_IDS}L, named_struct('a', _s.a, 'd', true),
            named_struct('a', transform(array({flags}), _f -> transform(array({joined}), _i -> {paired('_i')})[0])[0], 'd', false)))[0])"""
        long = f"""aggregate(sequence(1, octet_length({word})), named_struct('a', {start}, 'd', false), (_s, _n) -> {many},
            _s -> transform(_s.a, _e -> {ident('_e')}))"""
        return f"if(coalesce({word}, '') = '', cast(array() as array<int>), if(octet_length({word}) > {LONG}, {long}, {folded}))"

    def folded(self, df: DataFrame, words: str, out: str) -> DataFrame:
        """df with the column `words`, an array of strings, replaced by `out`, the array of their ids.

        The tables are a column used once, which the optimiser puts in its place (subqueries may not be written inside
        higher-order functions): no row carries them.
        """
        tables = fresh(df, "__tables")[0]
        ids = F.expr(f"transform(array(`{tables}`), _t -> transform(`{words}`, _w -> {self.fold_sql('_w')}))[0]")
        kept = [F.col(f"`{c}`") for c in df.columns if c != words]
        return df.withColumn(tables, F.expr(self.tables(df.sparkSession))).select(*kept, ids.alias(out))


@lru_cache(maxsize=4)
def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of characters below _PLAIN, with its classes written out, which the standard library matches in
    about half the time. None if it has more than literals, groups, alternatives, look-ahead and the classes L, N and s."""
    chars = [chr(i) for i in range(_PLAIN)]
    runs = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        of = np.array([bool(regex.match(name, c)) for c in chars] + [False]).astype(np.int8)
        edges = np.diff(of, prepend=0)
        ends = zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist(), strict=True)
        runs[name] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in ends)
    out, within = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|\(\?[:!]?|\[\^?|.", pattern, re.S):
        if part in runs:
            out.append(runs[part] if within else f"[{runs[part]}]")
        elif part == r"\S" and not within:
            out.append(f"[^{runs[chr(92) + 's']}]")
        elif part[0] == "\\" and part[1:] not in ("r", "n") or part in ("(?", "^", "$", "&", "~") or within and part[0] in "[-|":
            return None
        else:
            within = part[0] == "[" or within and part != "]"
            out.append(part)
    return re.compile("".join(out))


class Splitter:
    """The words of a text: matches of the pattern; long ones are then cut where no token can cross."""

    def __init__(self, tokenizer: Tokenizer):
        self.pattern, self.inside = tokenizer.pattern, tokenizer.inside

    def find(self) -> Callable[[bytes | None], list[str]]:
        matches, plain = regex.compile(self.pattern).findall, plain_pattern(self.pattern)
        beyond = re.compile(f"[^\\x00-{chr(_PLAIN - 1)}]").search

        def find(text: bytes | None) -> list[str]:
            t = (text or b"").decode()
            return plain.findall(t) if plain and (t.isascii() or not beyond(t)) else matches(t)

        return find

    def long(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The long ones among words, with their pieces."""
        return {w: self.cut(w) for w in words if len(w) * 4 > LONG and len(w.encode()) > LONG}

    def cut(self, word: str) -> list[str]:
        b = np.frombuffer(word.encode(), np.uint8)
        first = (b[1:] & 0xC0) != 0x80  # a character starts here
        at = (np.flatnonzero(first & ~self.inside[b[:-1], b[1:]]) + 1).tolist()
        data = b.tobytes()
        return [data[x:y].decode() for x, y in zip([0, *at], [*at, len(data)], strict=True)]


def count_words(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """word, c: the words of all texts; each task adds up before the shuffle."""
    split = Splitter(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = split.find(), Counter()
        for b in batches:
            for t in raw(b.column(0)):
                held.update(find(t))
                if len(held) > _HELD:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    def rows(held: Counter) -> pa.RecordBatch:
        for w, pieces in split.long(held).items():
            c = held.pop(w)
            for p in pieces:
                held[p] += c
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])

    return docs.select(text).mapInArrow(tidy(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class WordTable:
    """word -> ids, packed: sorted hashes, and for each a stretch of ids. A hit is checked by its bytes."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.hashes, self.offsets, self.ids = hashes, offsets, ids

    def find(self, words: list[str], pieces: pa.LargeBinaryArray) -> list[bytes | None]:
        """Each word's ids as little-endian 32-bit integers, or None if the table lacks it."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.hashes) or not words:
            return out
        coded = [w.encode() for w in words]
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, coded), np.uint64, len(coded))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        start, size = self.offsets[at[hit]], self.offsets[at[hit] + 1] - self.offsets[at[hit]]
        ends = np.cumsum(size)
        flat = self.ids[np.repeat(start - ends + size, size) + np.arange(size.sum())]
        # Equal hashes are not enough: the pieces of the ids must spell the word.
        spelled = decode_lists(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.astype(np.int32))), pieces)
        data = memoryview(flat.astype("<u4").tobytes())
        for i, lo, hi, s in zip(hit.tolist(), (4 * (ends - size)).tolist(), (4 * ends).tolist(), spelled, strict=True):
            if s == coded[i]:
                out[i] = bytes(data[lo:hi])
        return out


def word_table(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", most: int = MAX_WORDS) -> WordTable:
    """The table of the most frequent words, `most` at most."""
    spark = docs.sparkSession
    words = materialise(count_words(docs, tokenizer, text), "words")
    scale = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    have, least = 0, 63
    for k, n in sorted(words.groupBy(scale.alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 63 rows at most
        if have + n > most:
            break
        have, least = have + n, k

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, raw(b.column(0))), np.uint64, b.num_rows)
            parts = [h.tobytes(), np.diff(lists.offsets.to_numpy()).astype("<u4").tobytes(), lists.flatten().to_numpy().astype("<u4").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["h", "n", "ids"])

    if not have:
        return WordTable(np.empty(0, np.uint64), np.zeros(1, np.int32), np.empty(0, np.uint32))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    folded = tokenizer.folded(words.where(scale >= least).repartition(parts, "word").select("word", F.array("word").alias("words")), "words", "ids")
    folded = folded.select("word", F.col("ids")[0].alias("ids"))
    packed = materialise(folded.mapInArrow(tidy(pack), "h binary, n binary, ids binary"), "folded").toArrow()  # at most `most` words
    h, n, source = (np.frombuffer(b"".join(packed.column(c).to_pylist()), t) for c, t in (("h", "<u8"), ("n", "<u4"), ("ids", "<u4")))
    del packed
    kind = np.dtype("<u2" if len(tokenizer.pieces) <= 1 << 16 else "<u4")
    order, source, n = np.argsort(h), source.astype(kind), n.astype(np.int64)
    start, n = (np.cumsum(n) - n)[order], n[order]
    ends = np.cumsum(n)
    table = WordTable(h[order], np.concatenate([[0], ends]).astype(np.int32), source[np.repeat(start - ends + n, n) + np.arange(len(source))])
    release()
    return table


def encode(
    docs: DataFrame, tokenizer: Tokenizer, text: str = "text", most: int = MAX_WORDS, keep_text: bool = True, digests: bool = False, keep_tokens: bool = True
) -> DataFrame:
    """docs with tokens (array<int>): the ids of each whole text, without special tokens; null text has none. The text itself
    goes if keep_text is false, and then is read once only; so do the tokens. With digests, the ids are decoded again, in the
    same pass, and n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256 are added.

    A text of only empty matches has no tokens; repeated rows, extra columns and an empty table pass through; columns of
    the names that are added are replaced. The pattern is applied by Unicode rules.
    """
    added = [StructField("tokens", ArrayType(IntegerType()))] if keep_tokens else []
    added += [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())] if digests else []
    spark, docs = docs.sparkSession, docs.drop(*[f.name for f in added])
    shared = spark.sparkContext.broadcast(word_table(docs, tokenizer, text, most))
    spelled = spark.sparkContext.broadcast(piece_array(tokenizer))
    split = Splitter(tokenizer)
    c_ids, c_gaps, c_new = fresh(docs, "__ids", "__gaps", "__new")

    def known():
        table, pieces = shared.value, spelled.value
        find, cache = split.find(), {}

        def each(b: pa.RecordBatch, texts: list[bytes | None]) -> dict[str, pa.Array]:
            ids, gaps, new = [], [], []
            for lo, hi in _cuts(texts):
                matched = [find(t) for t in texts[lo:hi]]
                if len(cache) > _CACHED:
                    cache.clear()
                lack = list(set().union(*matched).difference(cache))
                if long := split.long(lack):  # the cache never holds them whole
                    matched = [m if long.keys().isdisjoint(m) else [p for w in m for p in long.get(w, (w,))] for m in matched]
                    lack = [w for w in set().union(*matched) if w not in cache]
                for w, found in zip(lack, table.find(lack, pieces), strict=True):
                    cache[w] = found
                for m in matched:
                    got = list(map(cache.__getitem__, m))
                    missing: dict[str, int] = {}
                    places: list[int] = []
                    i = -1
                    for _ in range(got.count(None)):
                        i = got.index(None, i + 1)
                        places.append(missing.setdefault(m[i], len(missing)))
                        got[i] = _GAP
                    ids.append(b"".join(got))
                    gaps.append(places)
                    new.append(list(missing))
            return {c_ids: pa.array(ids, pa.binary()), c_gaps: pa.array(gaps, pa.list_(pa.int32())), c_new: pa.array(new, pa.list_(pa.string()))}

        return each

    def join():
        def each(b: pa.RecordBatch, _: list[bytes | None]) -> dict[str, pa.Array]:
            column = lambda n: b.column(b.schema.get_field_index(n))
            lists = fill_gaps(column(c_ids), column(c_gaps), column(c_new))
            if not digests:
                return {"tokens": lists}
            flat, ends = lists.flatten().to_numpy().astype("<u4"), lists.offsets.to_numpy()
            parts = [flat[x:y] for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            decoded = [hashlib.sha256(x).hexdigest() for x in decode_lists(lists, spelled.value)]
            coded = [hashlib.sha256(a).hexdigest() for a in parts]
            made = {"n_tokens": [len(a) for a in parts], "ids_sha256": coded, "decoded_sha256": decoded}
            return {"tokens": lists} | {k: pa.array(v, pa.int64() if k == "n_tokens" else pa.string()) for k, v in made.items()}

        return each

    hidden = [StructField(c_ids, BinaryType()), StructField(c_gaps, ArrayType(IntegerType())), StructField(c_new, ArrayType(StringType()))]
    first = tokenizer.folded(map_rows(docs, text, hidden, known, drop=() if keep_text else (text,)), c_new, c_new)
    return map_rows(first, None, added, join, drop=(c_ids, c_gaps, c_new))


def _cuts(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= _SLICE:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def fill_gaps(ids: pa.Array, gaps: pa.Array, new: pa.Array) -> pa.ListArray:
    """The ids of each row, its gaps filled from its own new words: of the k-th gap, the ids of word gaps[k]. All rows at once."""
    sizes = np.array([len(x) // 4 for x in ids.to_pylist()], np.int64)
    given = np.frombuffer(b"".join(ids.to_pylist()), "<u4")
    at = np.flatnonzero(given == 0xFFFFFFFF)
    # A gap's word among all words of the batch, and where that word's ids lie.
    base = np.repeat(new.offsets.to_numpy()[:-1], np.diff(gaps.offsets.to_numpy()))
    word = gaps.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + base - new.offsets[0].as_py()
    words = new.flatten()
    start, source = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py(), words.flatten().to_numpy().astype(np.int32)
    long = np.diff(start)[word]

    widths = np.ones(len(given), np.int64)
    widths[at] = long
    ends = np.cumsum(widths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    known = np.ones(len(given), bool)
    known[at] = False
    out[ends[known] - 1] = given[known].astype(np.int32)
    step = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
    out[np.repeat(ends[at] - long, long) + step] = source[np.repeat(start[:-1][word], long) + step]
    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))


def piece_array(tokenizer: Tokenizer) -> pa.LargeBinaryArray:
    """The bytes of each id, by id."""
    return pa.array([tokenizer.pieces[i] for i in range(len(tokenizer.pieces))], pa.large_binary())


def decode_lists(lists: pa.ListArray, pieces: pa.LargeBinaryArray) -> list[bytes | None]:
    """The bytes that each list of ids stands for: its pieces, concatenated. The pieces of a batch are taken at once, and lie side by
    side in the result's buffer."""
    if not len(lists):
        return []
    flat = lists.flatten()
    taken = pieces.take(flat)
    _, places, data = taken.buffers()
    at = np.frombuffer(places, np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = memoryview(data) if data is not None else memoryview(b"")
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
    cuts = at[ends].tolist()
    return [bytes(data[x:y]) if valid else None for x, y, valid in zip(cuts, cuts[1:], lists.is_valid().to_pylist(), strict=False)]


def decode(df: DataFrame, tokenizer: Tokenizer, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """df with decoded (binary): null for null tokens. An id outside the vocabulary is an error. A column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(piece_array(tokenizer))

    def make():
        def each(b: pa.RecordBatch, _: list) -> dict[str, pa.Array]:
            return {out: pa.array(decode_lists(b.column(b.schema.get_field_index(tokens)), shared.value), pa.binary())}

        return each

    return map_rows(df, None, [StructField(out, BinaryType())], make)
