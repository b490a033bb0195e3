"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

Plan
----
1. One scan hashes every text into its set of distinct word n-grams.  Equal
   sets share a content key, so exact copies are one member from here on.
2. The n-grams go, packed per task, to parts by hash.  A part counts in how
   many different sets each n-gram occurs.  N-grams of one set only can match
   nothing and end here.
3. What is left returns to its set.  In the rare-first order single n-grams
   come first, so a set whose prefix holds only single n-grams has no partner;
   the rest keep their shared n-grams, sorted by rarity, and post their prefix.
4. Postings meet on the n-gram.  First every set is compared with the best
   leader (the shortest set of an n-gram) and the best neighbour it meets, which
   ties most near copies together with comparisons in proportion to their
   number.  Then everything that may still join two components is compared: in
   small groups pair by pair, after the length, positional and suffix filters;
   in groups of many near copies block by block, after the length filter.

An n-gram that is very common within one task is known there to be shared, so
its postings skip step 2 and sort behind all others: no part ever gathers the
postings of a hot n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .components import connected_components
from .hashing import U64, gram_hashes, mix64, sequence_hash, string_buffer, word_hashes
from .sizes import group_bytes, small
from .workspace import bound_batches, materialize

#: Runs in which sets whose 64-bit keys clash are told apart, such keys at most, and the bits of a key.
RUNS, CLASHES, KEY_BITS = 3, 10_000, 64
#: Size classes of leaders: sizes within one differ by less than this factor.
SIZE_CLASS = 1.125
#: Occurrences within one packing from which an n-gram counts as common.
COMMON = 8
#: Rarity classes; the last one holds all n-grams in so many sets or more, and the common ones.
RAREST_LAST = 255
#: Members up to which a group of components is compared pair by pair; sets in a block beyond that.
PAIRWISE = 64
BLOCK = 256
TOKENS, COMMON_TOKENS, SHARED, SIZES, ROW, SET = range(6)


def _pack7(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack7(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.reshape(-1).view("<u8")


def _schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()),
        T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("c", T.BinaryType()),
        T.StructField("id", id_type), T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("n_single", T.LongType()),
    ])


def _table(rows: list[tuple], id_type: pa.DataType) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["part", "kind", "a", "b", "c", "id", "key", "key2", "n", "n_single"]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)


def _joined(rows: list[tuple], rest: pa.Table) -> pa.Table:
    """New rows before passed-on ones, in the schema of the latter."""
    new = _table(rows, rest.schema.field("id").type)
    return pa.concat_tables([pa.Table.from_arrays([pa.nulls(len(rows), f.type) if f.name == "id" else new.column(f.name) for f in rest.schema], schema=rest.schema), rest])


def _route(x: np.ndarray, parts: int, bits: int) -> np.ndarray:
    return ((x >> U64(bits - 32)) * U64(parts) >> U64(32)).astype(np.int32)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(part[rows[0]]), rows


def shingle_sets(column: pa.Array, words_per_gram: int) -> list[np.ndarray]:
    """The sorted distinct 56-bit n-gram hashes of every text in a string column."""
    data, offsets = string_buffer(column)
    words, first = word_hashes(data, offsets)
    grams = gram_hashes(words, words_per_gram)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= words_per_gram:
            own = grams[a : b - words_per_gram + 1]
        elif b > a:
            own = sequence_hash(words[a:b])
        else:
            out.append(np.zeros(0, U64))
            continue
        out.append(np.unique(own >> U64(8)))
    return out


def _keys(own: np.ndarray, clashing: frozenset[int]) -> tuple[int, int]:
    """The 64-bit key that a set goes by, and 64 more bits that tell a clash; a key known to clash gives way to these."""
    key, more = int(mix64(own).sum(dtype=U64)) >> (64 - KEY_BITS), int(mix64(own + U64(0x632BE59BD9B4E019)).sum(dtype=U64))
    return (more, more) if key in clashing else (key, more)


def _scan(words_per_gram: int, parts: int, clashing: frozenset[int], flush_bytes: int):
    """Texts to packed n-grams by part, and a row for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        grams: list[np.ndarray] = []
        keys: list[int] = []
        held, turn, id_type = 0, 0, None

        def flush() -> pa.Table:
            rows = []
            if grams:
                token = np.concatenate(grams)
                sizes = np.array([len(g) for g in grams])
                key = np.array(keys, U64)
                owner = np.repeat(key, sizes)
                values, back, count = np.unique(token, return_inverse=True, return_counts=True)
                hot = count >= COMMON
                common = np.flatnonzero(hot[back])
                rare_token, rare_owner = np.delete(token, common), np.delete(owner, common)
                for p, at in _by_part(_route(rare_token, parts, 56)):
                    rows.append((p, TOKENS, _pack7(rare_token[at]), rare_owner[at].tobytes(), None, None, None, None, None, None))
                for p, at in _by_part(_route(values[hot], parts, 56)):
                    rows.append((p, COMMON_TOKENS, _pack7(values[hot][at]), None, None, None, None, None, None, None))
                for p, at in _by_part(_route(owner[common], parts, 64)):
                    rows.append((p, SHARED, _pack7(token[common[at]]), owner[common[at]].tobytes(), np.full(len(at), RAREST_LAST, np.uint8).tobytes(), None, None, None, None, None))
                for p, at in _by_part(_route(key, parts, 64)):
                    rows.append((p, SIZES, key[at].tobytes(), sizes[at].astype(np.int64).tobytes(), None, None, None, None, None, None))
            grams.clear()
            keys.clear()
            return _table(rows, id_type)

        for batch in batches:
            id_type = batch.schema.field(0).type
            docs = []
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for i, own in enumerate(shingle_sets(part.column(1), words_per_gram)):
                    if not len(own):
                        docs.append((None, None, 0))
                        continue
                    key, more = _keys(own, clashing)
                    docs.append((key, more, len(own)))
                    if key not in seen:
                        seen.add(key)
                        grams.append(own)
                        keys.append(key)
                        held += 8 * len(own)
                if held >= flush_bytes:
                    yield from flush().to_batches()
                    held = 0
            signed = [[None if d[k] is None else d[k] - (1 << 64) * (d[k] >> 63) for d in docs] for k in (0, 1)]
            none = pa.nulls(len(docs), pa.binary())
            turn += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs), (hash(docs[0]) + turn) % parts if docs else 0, np.int32)), pa.array(np.full(len(docs), ROW, np.int32)), none, none, none, batch.column(0), pa.array(signed[0], pa.int64()), pa.array(signed[1], pa.int64()), pa.array([d[2] for d in docs], pa.int64()), pa.nulls(len(docs), pa.int64())],
                names=["part", "kind", "a", "b", "c", "id", "key", "key2", "n", "n_single"],
            )
        if grams:
            yield from flush().to_batches()

    return run


def _count(parts: int):
    """A part's n-grams: how many sets each is in; those of several go on to their sets."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        pick = lambda k, c: [x for x in table.filter(pa.array(kind == k)).column(c).to_pylist()]
        token, owner = _unpack7(pick(TOKENS, "a")), np.frombuffer(b"".join(pick(TOKENS, "b")), U64)
        hot = np.unique(_unpack7(pick(COMMON_TOKENS, "a")))
        rows = []
        if len(token):
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            begin = np.r_[True, token[1:] != token[:-1]]
            group = np.cumsum(begin) - 1
            several = np.bincount(group) > 1
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token[begin]), len(hot) - 1)
                is_hot = hot[at] == token[begin]
                several |= is_hot
            else:
                is_hot = np.zeros(len(several), bool)
            some = several[group]
            token, owner, group = token[some], owner[some], group[some]
            order = np.lexsort((owner, group))
            token, owner, group = token[order], owner[order], group[order]
            once = np.r_[True, (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])][: len(token)]
            token, owner, group = token[once], owner[once], group[once]
            count = np.bincount(group, minlength=len(several))
            count[is_hot] = RAREST_LAST
            count = np.minimum(count, RAREST_LAST)[group]
            token, owner, count = token[count > 1], owner[count > 1], count[count > 1].astype(np.uint8)
            for p, at in _by_part(_route(owner, parts, 64)):
                rows.append((p, SHARED, _pack7(token[at]), owner[at].tobytes(), count[at].tobytes(), None, None, None, None, None))
        rest = table.filter(pa.array(kind >= SHARED))
        return _joined(rows, rest)

    return run


def _gather(numerator: int, denominator: int):
    """A part's sets: their shared n-grams in rare-first order, if their prefix holds any."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        pick = lambda k, c: b"".join(table.filter(pa.array(kind == k)).column(c).to_pylist())
        key, size = np.frombuffer(pick(SIZES, "a"), U64), np.frombuffer(pick(SIZES, "b"), np.int64)
        owner = np.frombuffer(pick(SHARED, "b"), U64)
        rows = []
        if len(owner):
            key, at = np.unique(key, return_index=True)
            size = size[at]
            token = _unpack7([pick(SHARED, "a")]) | np.frombuffer(pick(SHARED, "c"), np.uint8).astype(U64) << U64(56)
            which = np.searchsorted(key, owner)
            shared = np.bincount(which, minlength=len(key))
            if shared.max(initial=0) and (shared >= -(-numerator * size // denominator)).any():
                keep = (shared >= -(-numerator * size // denominator))[which]
                token, which = token[keep], which[keep]
                order = np.lexsort((token, which))
                token, which = token[order], which[order]
                fresh = np.r_[True, (token[1:] != token[:-1]) | (which[1:] != which[:-1])]
                token, which = token[fresh], which[fresh]
                cuts = np.flatnonzero(np.diff(which)) + 1
                for own, w in zip(np.split(token, cuts), which[np.r_[0, cuts]], strict=True):
                    need = -(-numerator * int(size[w]) // denominator)
                    if len(own) >= need:
                        prefix = own[: len(own) - need + 1]
                        rows.append((0, SET, own.tobytes(), prefix.tobytes(), None, None, int(key[w].astype(np.int64)), None, int(size[w]), int(size[w]) - len(own)))
        rest = table.filter(pa.array(kind == ROW))
        return _joined(rows, rest)

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At least so many members are in only one of two sorted runs."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    equal = int(at < len(x) and x[at] == y[middle])
    left = suffix_bound(x[:at], y[:middle], depth - 1)
    return left + (1 - equal) + suffix_bound(x[at + equal :], y[middle + 1 :], depth - 1)


def _verify(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            a, b, na, nb, sa, sb, i, j = (batch.column(k).to_pylist() for k in range(8))
            for r in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[r].as_buffer(), U64) for k in (8, 9))
                both = na[r] + nb[r]
                need = -(-numerator * both // (numerator + denominator))
                apart = both - 2 * need
                before = abs(i[r] - j[r])
                if before + suffix_bound(x[i[r] - sa[r] + 1 :], y[j[r] - sb[r] + 1 :]) > apart:
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if denominator * common >= numerator * (both - common):
                    links.append((a[r], b[r]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links among candidate pairs (a, b, i, j): both sets are brought to the pair."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("n_single").alias("sa"), F.col("grams").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("n_single").alias("sb"), F.col("grams").alias("y"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb", "i", "j", "x", "y")
    return full.mapInArrow(_verify(numerator, denominator), "a long, b long")


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_gram: int = 5, numerator: int = 80, denominator: int = 100,
) -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id).

    Two documents link when ``denominator * |A & B| >= numerator * |A | B|`` for
    their sets of distinct n-grams of ``words_per_gram`` words (A-Z lower-cased,
    words ``[^\\x20\\x09-\\x0D]+``); a text with fewer words has one n-gram, the
    whole sequence.  component_id is the smallest id reachable by links.

    Defined cases: a null or empty text, or one without words, has no n-grams
    and is alone; a null id takes part and never is the smallest (its component
    is null if it has no other member); repeated rows give repeated rows; an
    empty table gives an empty result; words and texts of any length are taken
    whole; other columns are ignored.  Sets are compared by 56-bit hashes of
    their n-grams and told apart by 128 bits: two texts of 1,000 words each are
    misjudged with a chance of about 10**-11.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unit = group_bytes(size)
    parts = max(4, -(-size // unit))
    id_type = docs.schema["id"].dataType
    schema = _schema(id_type)
    clashing: frozenset[int] = frozenset()
    for _ in range(RUNS):
        packed = docs.mapInArrow(_scan(words_per_gram, parts, clashing, unit), schema)
        counted = packed.repartition(parts, "part").groupBy("part").applyInArrow(_count(parts), schema)
        gathered = counted.repartition(parts, "part").groupBy("part").applyInArrow(_gather(numerator, denominator), schema)
        stage = materialize(gathered.select("kind", "a", "b", "id", "key", "key2", "n", "n_single"), "sets")
        rows = stage.where(f"kind = {ROW}").select("id", "key", "key2", "n")
        clash = rows.where("key is not null").groupBy("key").agg(F.min("key2").alias("low"), F.max("key2").alias("high")).where("low <> high")
        found = [r[0] % (1 << 64) for r in clash.select("key").limit(CLASHES + 1).collect()]
        if not found:
            break
        clashing |= frozenset(found)
        if len(clashing) > CLASHES:
            raise RuntimeError("too many sets have equal keys")
    else:
        raise RuntimeError(f"sets of different n-grams had equal keys in {RUNS} runs")
    sets = stage.where(f"kind = {SET}").select("key", "n", "n_single", F.col("a").alias("grams"), F.col("b").alias("prefix"))
    comps = _join(sets, numerator, denominator)
    firsts = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("first"))
    firsts = firsts.join(comps, firsts.key == comps.node, "left").select("key", "first", F.coalesce("comp", "key").alias("comp"))
    firsts = materialize(firsts, "firsts")
    smallest = firsts.groupBy("comp").agg(F.min("first").alias("component_id"))
    of_key = firsts.join(smallest, "comp").select("key", "component_id")
    found = rows.join(of_key, "key", "left")
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
        sizes = np.array([len(g) for g in grams], np.int64)
        key, n, single = (np.repeat(batch.column(k).to_numpy(), sizes) for k in range(3))
        place = np.concatenate([np.arange(s) for s in sizes]) if len(sizes) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams) if grams else np.zeros(0, np.int64)), pa.array(key), pa.array(n), pa.array(single + place)], names=["gram", "key", "n", "pos"])


def _join(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(node, comp) of all sets that have a link."""
    need = F.ceil(F.lit(numerator) * (F.col("na") + F.col("nb")) / F.lit(numerator + denominator))
    near = (F.lit(denominator) * F.least("na", "nb") >= F.lit(numerator) * F.greatest("na", "nb")) & (F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) >= need)
    posts = materialize(sets.select("key", "n", "n_single", "prefix").mapInArrow(_prefix_rows, "gram long, key long, n long, pos long"), "posts")
    # Leaders are minima by gram and size class, so a hot gram is combined before its shuffle.
    classed = posts.withColumn("size_class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZE_CLASS))))
    leads = small(materialize(classed.groupBy("gram", "size_class").agg(F.min(F.struct("n", "key", "pos")).alias("lead"), F.count("*").alias("m")), "leads"))
    asks = classed.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("size_class", F.col("size_class") - F.col("side"))
    met = asks.join(leads, ["gram", "size_class"]).where("side = 1 or m > 1").select(
        F.col("key").alias("a"), F.col("lead.key").alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb"), F.col("pos").alias("i"), F.col("lead.pos").alias("j"), "side",
    )
    met = met.where(near & (F.col("a") != F.col("b"))).groupBy("a", "b").agg(F.min(F.struct("i", "j")).alias("at"), F.min("side").alias("side"), F.count("*").alias("m"))
    best = met.groupBy("a", "side").agg(F.max(F.struct("m", "b", "at")).alias("top")).select("a", F.col("top.b").alias("b"), F.col("top.at.i").alias("i"), F.col("top.at.j").alias("j"))
    turn = F.col("a") > F.col("b")
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turn, F.col("j")).otherwise(F.col("i")).alias("i"), F.when(turn, F.col("i")).otherwise(F.col("j")).alias("j"))
    best = materialize(best.dropDuplicates(["a", "b"]), "best")
    links = materialize(_verified(best, sets, numerator, denominator), "links")
    comps = connected_components(links)
    # What may still link lies in one gram and in different components; grams tie such components into groups.
    posts = posts.join(comps, posts.key == comps.node, "left").select("gram", "key", "n", "pos", F.coalesce("comp", "key").alias("comp"))
    posts = materialize(posts, "posts")
    mixed = posts.groupBy("gram").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("gram", "low")
    open_posts = materialize(posts.join(mixed, "gram"), "open")
    ties = connected_components(open_posts.where("comp <> low").select(F.col("comp").alias("a"), F.col("low").alias("b")).distinct())
    ties = ties.select(F.col("node").alias("comp"), F.col("comp").alias("group"))
    members = posts.select("key", "n", "comp").distinct().join(ties, "comp")
    members = materialize(members, "members")
    sizes = members.groupBy("group").agg(F.count("*").alias("members"))
    few = sizes.where(F.col("members") <= PAIRWISE).select("group")
    more = _by_pairs(open_posts.join(ties.join(few, "group").select("comp"), "comp"), best.select("a", "b"), sets, near, numerator, denominator)
    more = more.union(_by_blocks(members.join(few, "group", "left_anti"), sets, numerator, denominator))
    more = materialize(more, "links")
    return connected_components(links.union(more)) if more.limit(1).count() else comps


def _by_pairs(posts: DataFrame, tried: DataFrame, sets: DataFrame, near: Column, numerator: int, denominator: int) -> DataFrame:
    """Links across components in small groups: pairs that share a gram and pass the filters and were not tried before, each verified once."""
    one = posts.select("gram", F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("i"), F.col("comp").alias("ca"))
    two = posts.select("gram", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("j"), F.col("comp").alias("cb"))
    pairs = one.join(two, "gram").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & near)
    pairs = pairs.groupBy("a", "b").agg(F.min(F.struct("i", "j")).alias("at")).select("a", "b", "at.i", "at.j").join(small(tried), ["a", "b"], "left_anti")
    return _verified(materialize(pairs, "pairs"), sets, numerator, denominator)


def _pack(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    lists = [r["grams"] for r in rows]
    column = lambda c: np.array([r[c] for r in rows], np.int64).tobytes()
    n = [r["n"] for r in rows]
    return pa.table({"group": pa.array([rows[0]["group"]], pa.int64()), "block": pa.array([rows[0]["block"]], pa.int64()), "low": pa.array([min(n)], pa.int64()), "high": pa.array([max(n)], pa.int64()), "keys": [column("key")], "comps": [column("comp")], "ns": [column("n")], "lengths": [np.array([len(x) // 8 for x in lists], np.int64).tobytes()], "grams": [b"".join(lists)]})


def overlaps(x: np.ndarray, x_row: np.ndarray, y: np.ndarray, y_row: np.ndarray, shape: tuple[int, int], width: int = 2048) -> np.ndarray:
    """Common members of every set of one block with every set of another, from (member, set number) columns."""
    both = np.intersect1d(x, y)
    out = np.zeros(shape, np.float32)
    for at in range(0, len(both), width):
        part = both[at : at + width]
        sides = []
        for members, rows, n in ((x, x_row, shape[0]), (y, y_row, shape[1])):
            place = np.searchsorted(part, members)
            place[place == len(part)] = 0
            hit = part[place] == members
            dense = np.zeros((n, len(part)), np.float32)
            dense[rows[hit], place[hit]] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _verify_blocks(numerator: int, denominator: int):
    """Block pairs to links that join different components, no more of them than join anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                side = {}
                for s in "xy":
                    keys, comps, ns, lengths = (np.frombuffer(r[f"{s}_{c}"], np.int64) for c in ("keys", "comps", "ns", "lengths"))
                    side[s] = keys, comps, ns, np.frombuffer(r[f"{s}_grams"], U64), np.repeat(np.arange(len(keys)), lengths)
                (xk, xc, xn, xg, xr), (yk, yc, yn, yg, yr) = side["x"], side["y"]
                common = overlaps(xg, xr, yg, yr, (len(xk), len(yk)))
                link = (denominator * common >= numerator * (xn[:, None] + yn[None, :] - common)) & (xc[:, None] != yc[None, :])
                parent: dict[int, int] = {}

                def root(v: int, parent: dict[int, int] = parent) -> int:
                    while parent.setdefault(v, v) != v:
                        parent[v] = v = parent[parent[v]]
                    return v

                out = []
                for i, j in zip(*np.nonzero(link), strict=True):
                    a, b = root(int(xc[i])), root(int(yc[j]))
                    if a != b:
                        parent[a] = b
                        out.append((int(xk[i]), int(yk[j])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _by_blocks(members: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Links across components in large groups, such as thousands of near copies.

    The members outside the group's largest component are dealt by size into
    blocks, and so are those inside; the former meet each other and the latter,
    where the length filter leaves a block pair.  Blocks are numbered by the
    counts of (group, side, size), so no task orders a group.  Every pair across
    components that can link lies in one block pair.
    """
    largest = members.groupBy("group", "comp").agg(F.count("*").alias("c")).groupBy("group").agg(F.max(F.struct("c", "comp")).alias("top")).select("group", F.col("top.comp").alias("largest"))
    sided = members.join(small(materialize(largest, "largest")), "group").withColumn("inside", (F.col("comp") == F.col("largest")).cast("long"))
    before = Window.partitionBy("group", "inside").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    counts = sided.groupBy("group", "inside", "n").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    place = F.shiftleft(F.floor(F.col("start") / BLOCK), 24) + F.pmod(F.xxhash64("key"), F.ceil(F.col("c") / BLOCK))
    dealt = sided.join(counts, ["group", "inside", "n"]).withColumn("block", 2 * place + F.col("inside"))
    rows = dealt.join(sets.select("key", "grams"), "key").select("group", "block", "key", "comp", "n", "grams")
    schema = "group long, block long, low long, high long, keys binary, comps binary, ns binary, lengths binary, grams binary"
    blocks = materialize(rows.groupBy("group", "block").applyInArrow(_pack, schema), "blocks")
    x, y = (blocks.select("group", F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in ("low", "high")]) for s in "xy")
    meet = (F.col("x_block") % 2 == 0) & ((F.col("y_block") % 2 == 1) | (F.col("x_block") <= F.col("y_block")))
    reach = lambda s, t: F.lit(denominator) * F.col(f"{s}_high") >= F.lit(numerator) * F.col(f"{t}_low")
    pairs = x.join(y, "group").where(meet & reach("x", "y") & reach("y", "x")).select("group", "x_block", "y_block")
    data = ("keys", "comps", "ns", "lengths", "grams")
    for s in "xy":
        pairs = pairs.join(blocks.select("group", F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in data]), ["group", f"{s}_block"])
    return pairs.select(*[f"{s}_{c}" for s in "xy" for c in data]).mapInArrow(_verify_blocks(numerator, denominator), "a long, b long")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS g FROM p),
c AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
m AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM m JOIN c x ON x.rid = a JOIN c y ON y.rid = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT any_value(x.doc_id) AS doc_id, any_value(coalesce(c.n, 0))::BIGINT AS n_shingles, min(y.doc_id) AS component_id
FROM r JOIN d x ON x.rid = r.a JOIN d y ON y.rid = r.b LEFT JOIN c ON c.rid = r.a GROUP BY r.a
"""
