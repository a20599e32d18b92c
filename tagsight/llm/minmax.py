"""Near duplicates by min-max hashing: both ends of every permutation, banded, and links confirmed on whole sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagsight.plans.lineage import durable

from .components import components
from .drops import mark, without
from .repeats import unsqueezed
from .tokens import text_slices
from .words import BLANK, LOWER, Words, mix, shingles

#: stands for a missing id, behind all others
NO_ID = (1 << 63) - 1
#: permutations; each gives two values, four values make a band
PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: members of one key that are compared in one task
BLOCK = 1000
#: a key of more rows is crowded: its pairs are confirmed where they are found
CROWD = 64
_FACTORS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; one for the whole of a text with fewer words, none without words."""
    w = Words(texts, BLANK, LOWER)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        h = w.hash[a:b]
        if len(h) >= width:
            out.append(np.unique(shingles(h, width)))
        elif len(h):
            out.append(shingles(h, len(h)) ^ np.uint64(len(h)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """Smallest and largest value of a set under every permutation, in turn."""
    low = np.full(PERMUTATIONS, ~np.uint64(0))
    high = np.zeros(PERMUTATIONS, np.uint64)
    for a in range(0, len(own), 1024):
        values = own[None, a : a + 1024] * _FACTORS[:, None]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.stack([low, high], 1).reshape(-1)


_SIGNED = "id long, mark long, digest binary, n_shingles long, sketch binary, keys array<long>"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    seats = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for batch in text_slices(batches, "text"):
        cols: list[list] = [[] for _ in range(3)]
        for own in shingle_sets(batch.column("text").to_pylist(), width):
            if len(own):
                s = signature(own)
                keys = mix(shingles_of_rows(s.reshape(BANDS, ROWS)) + seats).view(np.int64).tolist()
                sketch = mix(s).astype(np.uint8).tobytes()
            else:
                keys, sketch = [], b""
            for col, v in zip(cols, (len(own), sketch, keys), strict=True):
                col.append(v)
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
        named = ["id", "mark", "digest"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in named], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*named, "n_shingles", "sketch", "keys"]
        )


def shingles_of_rows(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = mix(out + rows[:, k])
    return out


def _likely(n1, n2, s1: np.ndarray, s2: np.ndarray, percent: int) -> np.ndarray:
    """True unless sizes rule a link out, or six standard errors of the signatures do."""
    size = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    p = percent / 100
    least = p - 6 * np.sqrt(p * (1 - p) / s1.shape[-1])
    return size & ((s1 == s2).mean(-1) >= least)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)


def _keep_likely(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = _likely(batch.column("n").to_numpy(), batch.column("cn").to_numpy(), _sketches(batch.column("sketch")), _sketches(batch.column("csketch")), percent)
        kept = batch.filter(pa.array(ok))
        a, b = kept.column("id").to_numpy(), kept.column("center").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The members of one key and block at a time."""

    def rows():
        for batch in batches:
            keys = batch.column("keys").flatten().to_numpy().reshape(-1, BANDS)
            for member, own in zip(batch.drop_columns(["keys"]).to_pylist(), keys, strict=True):
                yield member | {"keys": own}

    for _, members in groupby(rows(), lambda r: (r["key"], r["band"], r["low"], r["high"])):
        yield list(members)


def _candidates(members: list[dict], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Likely pairs of members with different labels, each in the first band whose key the two share only.

    The whole keys say which band that is: in the sketches a band can agree that the rows have no key for.
    """
    n, labels, own = (np.array([m[c] for m in members], np.int64) for c in ("n", "label", "own"))
    s = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint8).reshape(-1, 2 * PERMUTATIONS)
    keys = np.stack([m["keys"] for m in members])
    across = members[0]["low"] != members[0]["high"]
    for i in range(len(members)):
        rest = np.arange(i + 1, len(members))
        rest = rest[labels[rest] != labels[i]]
        if across:
            rest = rest[own[rest] != own[i]]
        if len(rest):
            rest = rest[_likely(n[i], n[rest], s[i], s[rest], percent)]
        if len(rest):
            rest = rest[(keys[i] == keys[rest]).argmax(1) == members[0]["band"]]
        if len(rest):
            yield i, rest


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The candidates of a key, to be confirmed elsewhere."""
    for members in _groups(batches):
        ids = np.array([m["id"] for m in members], np.int64)
        for i, rest in _candidates(members, percent):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[rest])), pa.array(np.maximum(ids[i], ids[rest]))], names=["a", "b"])


def true_sets(texts: list[str], width: int) -> list[set[bytes]]:
    """The shingles themselves, words joined by a blank; links are decided on these, not on hashes."""
    out = []
    for text in texts:
        words = text.encode().translate(LOWER.tobytes()).split()
        out.append({b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def _linked(one: set[bytes], other: set[bytes], percent: int) -> bool:
    both = len(one & other)
    return 100 * both >= percent * (len(one) + len(other) - both)


def _block_links(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The candidates of a crowded key, confirmed at once; a pair whose rows a link has joined meanwhile is passed over."""
    for members in _groups(batches):
        sets: dict[int, set[bytes]] = {}
        top = {m["label"]: m["label"] for m in members}

        def set_of(i: int, members=members, sets=sets) -> set[bytes]:
            if i not in sets:
                sets[i] = true_sets(unsqueezed([members[i]["body"]]), width)[0]
            return sets[i]

        def root(label: int, top=top) -> int:
            while top[label] != label:
                top[label] = top[top[label]]
                label = top[label]
            return label

        found = []
        for i, rest in _candidates(members, percent):
            for j in rest.tolist():
                x, y = root(members[i]["label"]), root(members[j]["label"])
                if x != y and _linked(set_of(i), set_of(j), percent):
                    top[max(x, y)] = min(x, y)
                    found.append(sorted((members[i]["id"], members[j]["id"])))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = 200
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            ends = [(part.column(i).to_pylist(), part.column(b).to_pylist()) for i, b in (("a", "body_a"), ("b", "body_b"))]
            new = {i: body for ids, bodies in ends for i, body in zip(ids, bodies, strict=True)}
            known = dict(zip(new, true_sets(unsqueezed(list(new.values())), width), strict=True))
            ok = []
            for a, b in zip(ends[0][0], ends[1][0], strict=True):
                ok.append(_linked(known[a], known[b], percent))
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in text_slices(batches, "text"):
        body = [squeeze((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(body, pa.binary())], names=["id", "digest", "body"])


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """Every row with its group of near duplicates: id, n_shingles, component_id (smallest id reachable), kept.

    Words end at [\\x20\\x09-\\x0D], A-Z lower-cased. Rows are linked when 100 * intersection >= percent * union of
    their sets of `width`-word shingles; a text with fewer words is one shingle, a text without words links to nothing.

    Rows with the same words (by md5 of the words) are folded to one at once. 64 permutations give 128 values, 32 bands
    of 4: a pair at 0.8 misses every band with probability below 1e-7. Rows that share a key are first compared with the
    key's most connected row only; where a key then still has several components, the pairs between components are compared
    block by block, those the signatures cannot rule out (six standard errors) are confirmed, and no pair is left
    out. Keys of up to `crowd` rows list such pairs and confirm them in joins; larger ones carry their texts to the
    block, confirm there and report links only. Links are confirmed on the shingles of whole texts, however long.

    Rows are told apart by their words, never by their id: rows that repeat an id keep links of their own and are all
    returned, and NULL ids are behind all others. Other columns are not read, an empty table gives an empty result.
    """
    found = _found(docs, width, percent, id_col, text_col, block, crowd)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(known("id").alias(id_col), "n_shingles", known("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def _found(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """Every row (id, mark) with n_shingles, its group, and the smallest id of the group (component)."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), "[ \\t-\\r]+", " "))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), mark(text_col).alias("mark"), F.unhex(F.md5(words)).alias("digest"), F.col(text_col).alias("text"))
    signed = durable(rows.mapInArrow(lambda b: _sign(b, width), _SIGNED))
    folded = signed.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "sketch", "keys")).alias("r"))
    kinds = durable(folded.select("digest", F.col("r.id").alias("least"), "r.n_shingles", "r.sketch", "r.keys", F.monotonically_increasing_id().alias("id")))
    banded = kinds.select(F.posexplode("keys").alias("band", "key"), "id")
    shared = durable(banded.groupBy("key").count().where("count > 1"))
    open_ = durable(banded.join(shared, "key").select("key", "band", "id", "count"))
    popular = open_.groupBy("id").agg(F.sum("count").alias("popularity"))
    wanted = durable(popular.join(kinds.select("id", F.col("n_shingles").alias("n"), "sketch"), "id"))
    firsts = kinds.join(wanted.select("id"), "id").select(F.col("id").alias("kind"), F.col("least").alias("id"), "digest")
    bodies = rows.select("id", "digest", "text").mapInArrow(_squeeze, "id long, digest binary, body binary").join(firsts, ["id", "digest"])
    bodies = durable(bodies.dropDuplicates(["kind"]).select(F.col("kind").alias("id"), "body"))
    member = durable(open_.select("key", "band", "id").join(wanted, "id"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a")
        with_b = with_a.join(bodies.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")
        return durable(with_b.mapInArrow(lambda b: _confirm(b, width, percent), "a long, b long"))

    center = member.groupBy("key").agg(F.max_by(F.struct("id", "n", "sketch"), F.struct("popularity", -F.col("id"))).alias("c"))
    centers = durable(center.select("key", F.col("c.id").alias("center"), F.col("c.n").alias("cn"), F.col("c.sketch").alias("csketch")))
    star = member.join(centers, "key").where("id != center").select("id", "n", "sketch", "center", "cn", "csketch")
    tested = durable(star.mapInArrow(lambda b: _keep_likely(b, percent), "a long, b long").distinct())
    links = confirmed(tested)
    labels = components(links)

    # keys whose rows still lie in several components
    named = member.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    named = durable(named.select("key", "band", "id", "label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("rows"))
    mixed = durable(mixed.where("least < most AND rows > 2").select("key", F.ceil(F.col("rows") / block).cast("int").alias("blocks"), (F.col("rows") > crowd).alias("crowded")))
    signs = kinds.select("id", F.col("n_shingles").alias("n"), "sketch", "keys")
    split = named.join(mixed, "key").join(signs, "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("other", "blocks")

    def grouped(df: DataFrame) -> DataFrame:
        return df.drop("crowded").repartition("key", "low", "high").sortWithinPartitions("key", "band", "low", "high")

    few = grouped(split.where("NOT crowded")).mapInArrow(lambda b: _block_pairs(b, percent), "a long, b long")
    more = confirmed(few.distinct().join(tested, ["a", "b"], "left_anti"))
    within = grouped(split.where("crowded").join(bodies, "id")).mapInArrow(lambda b: _block_links(b, width, percent), "a long, b long")
    more = durable(more.union(within).distinct())
    if not more.isEmpty():
        labels = components(links.union(more))

    grouped_ = kinds.select("digest", "id", "least").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    grouped_ = durable(grouped_.select("digest", "label", "least"))
    first = grouped_.groupBy("label").agg(F.min("least").alias("component"))
    of_kind = durable(grouped_.join(first, "label").select("digest", F.col("label").alias("group"), "component"))
    found = signed.select("id", "mark", "n_shingles", "digest").join(of_kind, "digest", "left")
    return found.select("id", "mark", "n_shingles", "group", F.coalesce("component", "id").alias("component"))


def drop_near(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns.

    The row with the smallest id of its group stays, of rows of one id that with the smallest hash of its text; rows
    that are alike in both all stay (`drop_copies` removes them). Rows without words have no group and stay: NULL, empty
    and blank texts. NULL ids are behind all others. An empty table stays empty.
    """
    found = durable(_found(docs, width, percent, id_col, text_col).where("`group` IS NOT NULL").select("id", "mark", "group", "component"))
    first = found.where("id = component").groupBy("group").agg(F.min("mark").alias("first"))
    gone = found.join(first, "group").where("id != component OR mark != first").select(F.when(F.col("id") != NO_ID, F.col("id")), "mark")
    return without(docs, gone, [F.col(id_col).cast("long"), mark(text_col)])
