"""N-gram Jaccard join with token-combination prefixes.

A document is the set of hashes of its word n-grams. Tokens have a global order: rare, medium, frequent (classes that a pass
over all documents counts), then by hash. A prefix grows until no linked document can avoid sharing a signature:
single tokens of the rare and medium classes, pairs of tokens of the frequent class. The frequent class is dealt to parts by
hash, about eight prefix tokens each, and only tokens of one part pair: signatures stay in proportion to the text. With t the
tokens that a linked document may lack and n_i tokens of class or part i in the prefix, combinations of k_i, that is
sum max(0, n_i - k_i + 1) > t. A set grows its prefix by the parts of its own size, and pairs within those of the smallest set
that may link with it, which hold the parts of every such set.

1. Equal sets become one (by a digest of 128 bits, also their id); only distinct sets go on.
2. Postings (signature, set) are counted; signatures of one set go, and so do those with the same sets as another.
3. Inside a signature, parity sketches bound the difference of two sets from below. A search that removes each set
   as it is reached gives a spanning forest of candidates: no group is ever listed as all its pairs. Large groups are cut
   into blocks, and each two blocks meet in a task of their own.
4. Candidates are verified on the whole sets; links make components. A second search lists the candidates that lie
   between different components (few, where sketches are sharp), and verifies them all. So no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestat.llm import bloom
from tidestat.llm.common import LOWER_BLANK, fresh, join_hot, materialise, raw, spread, tidy
from tidestat.llm.components import components

SHINGLE = 3
PERCENT = 90
#: Document counts (in tasks that saw a token twice or more) from which a token is medium, and frequent; doubled as often as it takes
#: for no more than CLASS_TOKENS tokens to be. The classes are bitmaps of CLASS_BITS bits (8 MB).
MEDIUM, FREQUENT = 8, 256
CLASS_BITS, CLASS_TOKENS = 1 << 26, 1 << 23
#: Prefix tokens of the frequent class in one part, about.
PART = 8
#: Sets in one block of a signature's group.
BLOCK = 2048
_U = np.uint64
_HELD = 1_000_000


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word k-grams; with fewer words, of the whole sequence; none without words."""
    words = text.translate(LOWER_BLANK).split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, n)
    m = min(k, n)
    out = spread(h[: n - m + 1], 100 + m)
    for i in range(1, m):
        out = spread(out + h[i : n - m + 1 + i], i)
    return np.unique(out)


def slack(n: np.ndarray | int, percent: int):
    """Tokens of a set of n that a linked set may lack."""
    return n - -(-n * percent // 100)


def digest(tokens: np.ndarray) -> bytes:
    """A 128-bit digest of a set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of tokens by hash: two sketches differ in at most as many bits as the sets differ in tokens.

    Longer sets have more bits; folding a sketch in halves (xor) gives that of fewer bits.
    """
    size = 1024 if len(tokens) <= 4096 else 4096 if len(tokens) <= 16384 else 16384
    at = (spread(tokens, 51) % _U(size)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8)).tobytes()


def parts(n: int, percent: int) -> int:
    """Parts of the frequent class for a set of n: a power of two that does not fall with n."""
    return 1 << max(0, ((int(slack(n, percent)) + 1) // PART).bit_length() - 1)


def signatures(tokens: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The signatures of a set, given each token's class (0 rare, 1 medium, 2 frequent)."""
    need = int(slack(len(tokens), percent)) + 1
    order = np.lexsort((tokens, classes))
    singles = int((classes < 2).sum())
    out = [spread(tokens[order[: min(need, singles)]], 41)]
    if singles < need and singles < len(tokens):
        f = tokens[order[singles:]]
        deal = spread(f, 44)
        # Each token beyond a part's first is one that a linked set has to lack.
        first = np.zeros(len(f), bool)
        first[np.unique(deal % _U(parts(len(tokens), percent)), return_index=True)[1]] = True
        enough = np.flatnonzero(np.cumsum(~first) >= need - singles)
        f = f[: enough[0] + 1 if len(enough) else len(f)]
        part = deal[: len(f)] % _U(parts(-(-len(tokens) * percent // 100), percent))
        by = np.argsort(part, kind="stable")
        f, part = f[by], part[by]
        for d in range(1, int(np.unique(part, return_counts=True)[1].max())):
            i = np.flatnonzero(part[d:] == part[:-d])
            out.append(spread(f[i] + spread(f[i + d], 42), 43))
    return np.concatenate(out)


def _profile(docs: DataFrame, k: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """Rows of (doc, n, id), and rows without them of (tokens, counts): tokens that a task saw in several documents,
    among the least by hash of each document (twice its prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            n, ids = [], []
            for t in raw(b.column(1)):
                s = shingle_set(t, k)
                n.append(len(s))
                ids.append(digest(s))
                held.append(s[: 2 * (int(slack(len(s), percent)) + 1)])
                size += len(held[-1])
            empty = pa.nulls(len(n), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), empty, empty], names=names
            )
            if size > _HELD:
                yield from counts(held)
                held, size = [], 0
        yield from counts(held)

    def counts(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, _U), np.empty(0, int))
        token, c = token[c > 1].view(np.int64), c[c > 1]
        for lo in range(0, len(token), 100_000):
            lists = [pa.array([x[lo : lo + 100_000]], pa.list_(pa.int64())) for x in (token, c)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), *lists], names=names)

    names = ["doc", "n", "id", "tokens", "counts"]
    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(
        tidy(run), "doc long, n long, id binary, tokens array<long>, counts array<long>"
    )


def token_classes(profile: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A function from tokens to classes, the same in every task: two bitmaps of a fixed size."""
    counts = profile.where("n = -1").select(F.inline(F.arrays_zip("tokens", "counts"))).toDF("token", "c")
    total = materialise(counts.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= MEDIUM), "token-counts")
    scale = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    sizes = dict(total.groupBy(scale.alias("k")).agg(F.count("*").alias("n")).collect())  # 64 rows at most

    def often(least: int) -> DataFrame:
        while sum(n for k, n in sizes.items() if k >= least.bit_length() - 1) > CLASS_TOKENS:
            least *= 2
        return total.where(F.col("c") >= least).select("token")

    medium, frequent = bloom.bitmap(often(MEDIUM), CLASS_BITS), bloom.bitmap(often(FREQUENT), CLASS_BITS)
    return lambda t: medium(t).astype(np.int8) + (medium(t) & frequent(t)).astype(np.int8)


def _fold(words: np.ndarray, to: int) -> np.ndarray:
    """Sketches (rows of uint64) folded to `to` words: the parity of a bit taken modulo fewer bits."""
    while words.shape[1] > to:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


class Group:
    """The sets of one signature (or of two of its blocks), with what decides candidates."""

    def __init__(self, ids: list[bytes], n: list[int], sketches: list[bytes], labels: list[bytes], percent: int):
        order = sorted(range(len(ids)), key=lambda i: (n[i], ids[i]))
        self.ids, self.n, self.percent = [ids[i] for i in order], np.array(n)[order], percent
        number: dict[bytes, int] = {}
        self.labels = np.array([number.setdefault(labels[i], len(number)) for i in order])
        size = np.array([len(s) for s in sketches])[order]
        self.levels = []  # (members, their sketches folded to that level's size): those at least as long
        for z in sorted(set(size.tolist())):
            at = np.flatnonzero(size >= z)
            words = np.concatenate([_fold(np.frombuffer(sketches[order[i]], _U)[None], z // 8) for i in at])
            self.levels.append((z, at, words))
        self.size = size

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        """Which of `among` (sorted indices) may link with i."""
        n = self.n
        fit = among[(100 * np.minimum(n[among], n[i]) >= self.percent * np.maximum(n[among], n[i])) & (among != i)]
        out = []
        for z, at, words in self.levels:
            if z > self.size[i]:
                break
            some = fit[self.size[fit] == z] if z < self.size[i] else fit[self.size[fit] >= z]
            if not len(some):
                continue
            me = words[np.searchsorted(at, i)]
            differ = np.bitwise_count(words[np.searchsorted(at, some)] ^ me).sum(1, dtype=np.int64)
            out.append(some[(100 + self.percent) * differ <= (100 - self.percent) * (n[some] + n[i])])
        return np.sort(np.concatenate(out)) if out else among[:0]

    def forest(self) -> list[tuple[int, int]]:
        """A spanning forest of the candidates."""
        left, out = np.arange(len(self.ids)), []
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                i = queue.pop()
                found = self.near(i, left)
                if len(found):
                    out += [(i, int(j)) for j in found]
                    queue += found.tolist()
                    left = left[~np.isin(left, found, assume_unique=True)]
        return out

    def across(self) -> list[tuple[int, int]]:
        """All candidates between different labels."""
        out, everyone, labels = [], np.arange(len(self.ids)), self.labels
        for i in everyone:
            later = everyone[i + 1 :]
            out += [(int(i), int(j)) for j in self.near(int(i), later[labels[later] != labels[i]])]
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (sig, x, y, id, n, sketch, label) of one (sig, x, y) after the other; each id once."""
    now, rows = None, {}
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if r[:3] != now:
                if len(rows) > 1:
                    yield list(rows.values())
                now, rows = r[:3], {}
            rows[r[3]] = r
    if len(rows) > 1:
        yield list(rows.values())


def _candidates(members: DataFrame, percent: int, labelled: bool) -> DataFrame:
    """a, b: a spanning forest of each group's candidates, or all those between different labels."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "n", "sketch", "label")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[bytes, bytes]] = set()
        for rows in _groups(batches):
            if labelled and len({r[6] for r in rows}) == 1:
                continue
            g = Group([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows], percent)
            for i, j in g.across() if labelled else g.forest():
                a, b = g.ids[i], g.ids[j]
                out.add((a, b) if a < b else (b, a))
            if len(out) > 50_000:
                yield pairs(out)
                out = set()
        yield pairs(out)

    def pairs(out: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], names=["a", "b"])

    return dealt.repartition("sig", "x", "y").sortWithinPartitions("sig", "x", "y").mapInArrow(tidy(run), "a binary, b binary").distinct()


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets link."""
    both = pairs.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hold = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.sort(np.concatenate([s, t]))
                inter = int((both[1:] == both[:-1]).sum())
                hold.append(100 * inter >= percent * (len(s) + len(t) - inter))
            kept = pa.array(hold, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept)], names=["a", "b"])

    return both.mapInArrow(tidy(run), "a binary, b binary")


def jaccard_components(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Words are runs of bytes other than white space, A-Z lowered; the set is the distinct word shingles (a shorter
    text: its whole sequence). Rows link when 100 * intersection >= percent * union; component_id is the
    smallest doc_id that links reach, the row's own included. percent is above 50.
    Cases: a text that is null or has no words has an empty set, links with nothing and keeps its own doc_id; a row without
    doc_id takes part with its text but never gives its component the id; repeated rows are equal sets; an empty table
    gives an empty table; other columns are ignored.
    """
    profile = materialise(_profile(docs, shingle, percent, doc_id, text), "profile")
    sets_of = profile.where("n > 0")
    distinct = materialise(sets_of.groupBy("id").agg(F.min("doc").alias("doc"), F.first("n").alias("n")), "distinct-sets")
    classes = token_classes(profile)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    first = bloom.member(distinct.where("doc is not null").select("doc"), distinct.count())
    unnamed = distinct.where("doc is null").limit(1).count() > 0

    def chosen(b: pa.RecordBatch, test, nameless: bool) -> Iterator[np.ndarray]:
        """The sets of the batch's rows that test lets through (those without doc_id if nameless); sets of one have no links."""
        ids = b.column(0)
        hold = test(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)).tolist()
        for h, known, t in zip(hold, ids.is_valid().to_pylist(), raw(b.column(1)), strict=True):
            if h if known else nameless:
                s = shingle_set(t, shingle)
                if len(s) > 1:
                    yield s

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, ids, n, sketches = [], [], [], []
            for s in chosen(b, first, unnamed):
                sig.append(signatures(s, classes(s), percent))
                ids.append(digest(s))
                n.append(len(s))
                sketches.append(sketch(s))
            if not ids:
                continue
            names, sigs = ["sig", "id", "n", "sketch"], np.concatenate(sig).view(np.int64)
            kind, none = pa.binary(), len(sigs)
            owner = pa.array(ids, kind).take(pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in sig])))
            yield pa.RecordBatch.from_arrays([pa.array(sigs), owner, pa.nulls(none, pa.int64()), pa.nulls(none, pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids, kind), pa.array(n, pa.int64()), pa.array(sketches, kind)], names=names)

    written = materialise(rows.mapInArrow(tidy(post), "sig long, id binary, n long, sketch binary"), "postings")
    postings, sketches = written.where("sig is not null").select("sig", "id"), written.where("sketch is not null").drop("sig")
    # Signatures of two sets or more; a filter of them thins the postings before these shuffle.
    shared = postings.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("sig")
    shared = materialise(shared, "signatures")
    probable = bloom.member(shared, shared.count())

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(probable(b.column(0).to_numpy().view(_U))))

    listed = postings.mapInArrow(tidy(thin), postings.schema).join(shared, "sig", "left_semi").distinct()
    listed = materialise(listed, "members")
    h = F.xxhash64("id")
    same = [F.count("*").alias("size"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("f1"), F.sum(F.shiftrightunsigned(h, 32)).alias("f2")]
    kept = listed.groupBy("sig").agg(*same).groupBy("size", "f1", "f2").agg(F.min("sig").alias("sig"))
    kept = materialise(kept.select("sig", "size"), "groups")
    listed = materialise(join_hot(listed, kept, ["sig"], "size", listed.count()), "members")
    members = materialise(listed.join(sketches, "id"), "sketched")
    pairs = materialise(_candidates(members.withColumn("label", F.col("id")), percent, False), "candidates")
    # The forest touches every set that has a candidate: only these sets are needed whole.
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    needed = materialise(needed.join(distinct.select("id", "doc"), "id"), "needed")
    wanted = bloom.member(needed.where("doc is not null").select("doc"), needed.count())
    nameless = needed.where("doc is null").limit(1).count() > 0

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tokens = [], []
            for s in chosen(b, wanted, nameless):
                ids.append(digest(s))
                tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(tokens, pa.binary())], names=["id", "tokens"])

    sets = materialise(rows.mapInArrow(tidy(whole), "id binary, tokens binary"), "sets")
    links = materialise(_links(pairs, sets, percent), "links")
    labels = components(links, "labels")
    again = members.join(labels, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    more = materialise(_links(materialise(_candidates(again, percent, True), "candidates"), sets, percent), "links")
    labels = components(links.unionByName(more), "labels")
    named = distinct.join(labels, "id", "left").select("id", "doc", F.coalesce("root", "id").alias("root"))
    least = materialise(named.groupBy("root").agg(F.min("doc").alias("component_id")), "least")
    sizes = sets_of.groupBy("id").agg(F.count("*").alias("rows"))
    table = named.join(least, "root").join(sizes, "id").select("id", "rows", "component_id")
    table = materialise(table, "classes")
    documents = materialise(sets_of.select("doc", "n", "id"), "documents")
    out = join_hot(documents, table, ["id"], "rows", documents.count())
    alone = profile.where("n = 0").select("doc", "n", F.lit(None).cast("long").alias("component_id"))
    return out.select("doc", "n", "component_id").unionByName(alone).select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")
    )


def dedup_documents(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id. Rows that share a doc_id are one document:
    its rows stay or go together. Rows without doc_id stay."""
    found = jaccard_components(docs, shingle, percent, doc_id, text)
    c_gone = fresh(docs, "__gone")[0]
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias(c_gone)).distinct()
    return docs.join(gone, F.col(doc_id).cast("long") == F.col(c_gone), "left_anti")
