"""N-gram Jaccard self-join: the connected components of documents whose word shingles are alike, exactly.

Two texts link when 100 |A and B| >= percent |A or B| for their sets of shingles (lower-cased A-Z, words between blanks;
fewer than `words` words: all of them as one shingle). Steps, each written to the shared folder before the next:

1. Texts with equal sets are one class (by a digest of the set), so copies cost one row each from here on.
2. A filter on the lowest BAND of shingle hashes. Tokens (shingles) have a global order, rare ones first. A set can
   miss at most slack(n) tokens of a partner's, so partners share one of its slack(n) + 1 first tokens; a class whose
   first tokens occur in no other class has no links and leaves.
3. The others' full sets. Cheap stars: classes with equal minima of several permutations are compared with the one of
   the least private tokens among them. Links found join classes to groups, so that a large set of near copies is one
   group before pairs are made.
4. Token-combination prefixes over what is left. A token of one group only is free: it can match nothing elsewhere.
   The prefix takes the rarest tokens until slack(n) + 1 errors would be needed to destroy all its signatures: a rare
   token (at most RARE groups) is one by itself, which an error destroys; frequent tokens fall into classes (the more,
   the larger the set: LEVELS) of which the pairs are signatures, so that c tokens of a class need c - 1 errors. Sets too
   small for pairs use single tokens; sets near a border between levels use both, so that any two partners share a kind
   of signature.
5. Classes of different groups with a common signature, whose sizes and numbers of tokens that are not free allow the
   threshold, become pairs: first each with the signature's class of the least free tokens, whose links make groups grow
   once more, then the groups that are still apart. In a signature of many groups, classes that share one of its leading
   signatures (crowded()) meet there and not here, so that alike classes do not meet anew in each of their signatures.
   Pairs whose token parities allow the threshold are verified on their full sets.
6. Components of all links by alternating stars.

No step holds a posting list, a group or a component in one task; frequencies travel as sorted blocks of tokens, over
as many hops as keep the number of rows in proportion to the input, and come back only for tokens of two groups and more. Hashes are 64 bits, cut to 48 after sets were formed: a false match
within a pair has odds of about |A||B| / 2**48.

Null texts and texts without words have no shingles and link with nothing. Null ids sort last and count as one id;
rows with equal ids are separate documents unless their texts are equal, too. Only doc_id and text are read, whatever
other columns are called. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import drop_table, free_caches, map_batches, release_shuffles, stage_table, utf8_list
from tallyspark.llm.shingles import mix, shingle_sets

BAND, RARE = 0.35, 64
#: Classes of frequent tokens, for larger and larger sets; 0: no classes, single tokens.
LEVELS = (0, 32, 256)
#: Entries from which a signature is crowded, and how many leading signatures then keep pairs apart.
CROWD, LEADERS, NO_LEADER = 64, 12, -(2**63)
BITS = 48
#: Bytes of tokens in a block, which a task holds as a whole, and into how many scopes a task's tokens are cut at most.
BLOCK, FAN = 4 << 20, 512
STARS, AGREED = 8, 4
LOW = np.uint64(int(BAND * 2**BITS))
NULL_KEY = 2**63 - 1


def slack(n: int, percent: int) -> int:
    """How many of n tokens may be missing from a partner."""
    return n - -(-percent * n // 100)


def to_bytes(tokens: np.ndarray) -> bytes:
    """Sorted 48-bit tokens, 6 bytes each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_bytes(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def _digest(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def keyed(docs: DataFrame, *columns) -> DataFrame:
    """key and th (digest of the text) of every row, which tell apart what counts as two documents, and columns."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.xxhash64("text").alias("th"), *columns)


def shingle_table(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, th, n, cid, low): each text's number of shingles, the digest of its set and its first tokens by (band, hash)."""
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("key", "th", "n", "cid")], T.StructField("low", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> dict:
        free_caches()
        sets = shingle_sets(utf8_list(batch.column(2)), words)
        cut = [s >> np.uint64(64 - BITS) for s in sets]
        low = [to_bytes(c[: max(int(np.searchsorted(c, LOW)), slack(len(c), percent) + 1)]) if len(c) else None for c in cut]
        return {"key": batch.column(0), "th": batch.column(1), "n": [len(s) for s in sets], "cid": [_digest(s) if len(s) else None for s in sets], "low": low}

    return map_batches(keyed(docs, "text"), run, schema)


SKETCH = [f"s{i}" for i in range(16)]
SETS = T.StructType([*[T.StructField(c, T.LongType()) for c in ("cid", "n", "free")], T.StructField("tokens", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in SKETCH]])


def parities(own: np.ndarray) -> np.ndarray:
    """64 * len(SKETCH) bits, each the parity of the number of tokens that fall on it. Two sets' parities differ in at most
    as many bits as the sets differ in tokens, and in nearly as many if those are few."""
    bits = 64 * len(SKETCH)
    odd = np.bincount((mix(own) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """SETS of the classes wanted (cid, key, th, free), from the text of the document named by key and th.

    Repeated rows are made one before texts are shuffled. The same plan serves every size.
    """

    def run(batch: pa.RecordBatch) -> dict:
        out = {c: [] for c in SETS.names}
        for cid, free, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), shingle_sets(utf8_list(batch.column(0)), words)):
            tokens = own >> np.uint64(64 - BITS)
            for k, v in zip(out, (cid, len(own), free, to_bytes(tokens), *parities(tokens).tolist())):
                out[k].append(v)
        return out

    rows = keyed(docs, "text").groupBy("key", "th").agg(F.first("text").alias("text")).join(wanted.hint("merge"), ["key", "th"])
    return map_batches(rows.select("text", "cid", "free"), run, SETS)


def place(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Which of `ranges` a token belongs to; a hash deals them, as the lowest tokens are all that some callers have."""
    with np.errstate(over="ignore"):
        return (((mix(tokens) >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


MIXED = -(2**63)
ASK = T.StructType([T.StructField("scope", T.LongType()), T.StructField("asker", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ("tokens", "counts", "owners")]])
ANSWER = T.StructType([T.StructField("asker", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def split(asker: int, tokens: np.ndarray, count: np.ndarray, owner: np.ndarray | None, ranges: int, width: int) -> list[tuple]:
    """ASK rows of sorted distinct tokens: one for each scope, `width` neighbouring ranges."""
    scope = place(tokens, ranges) // width
    order = np.argsort(scope, kind="stable")
    scope, tokens, count = scope[order], tokens[order], count[order].astype(np.uint32)
    owner = None if owner is None else owner[order]
    cuts = np.flatnonzero(np.concatenate(([True], scope[1:] != scope[:-1], [True]))) if len(scope) else []
    return [(int(scope[x]), asker, to_bytes(tokens[x:y]), count[x:y].tobytes(), b"" if owner is None else owner[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:])]


def gathered(frame: pd.DataFrame, groups: bool) -> tuple:
    """Of ASK rows: all tokens in order, the row each comes from, where each distinct one begins, its total and whether it is one group's."""
    own = [from_bytes(t) for t in frame["tokens"]]
    row = np.repeat(np.arange(len(own), dtype=np.int32), [len(t) for t in own])
    tokens = np.concatenate(own)
    del own
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    total = np.add.reduceat(np.frombuffer(b"".join(frame["counts"]), np.uint32)[order].astype(np.int64), first)
    if not groups:
        return tokens, row, first, total, np.where(total == 1, 0, MIXED)
    owner = np.frombuffer(b"".join(frame["owners"]), np.int64)[order]
    low = np.minimum.reduceat(owner, first)
    return tokens, row, first, total, np.where(low == np.maximum.reduceat(owner, first), low, MIXED)


def exchange(asks: DataFrame, groups: bool, ranges: int, width: int) -> DataFrame:
    """ANSWERs to ASK rows: the tokens that are of two groups and more, with their frequencies.

    With one range a scope, a task has all rows of its range and answers. With more, the askers of a scope are bundled, as
    many bundles as the scope has ranges: a task makes one ask of a bundle's, of about a block's size, for narrower scopes,
    and hands the answers on. So a task never has more than about a block of tokens, and rows grow as blocks * FAN for each
    level, not as blocks squared.
    """
    if width == 1:

        def reply(frame: pd.DataFrame) -> pd.DataFrame:
            tokens, row, first, total, owner = gathered(frame, groups)
            size = np.diff(np.concatenate((first, [len(tokens)])))
            shared = np.repeat(owner == MIXED, size)
            tokens, row, total = tokens[shared], row[shared], np.minimum(np.repeat(total, size)[shared], 2**32 - 1).astype(np.uint32)
            order = np.argsort(row, kind="stable")
            tokens, row, total = tokens[order], row[order], total[order]
            cuts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else []
            askers = frame["asker"].to_numpy()
            return pd.DataFrame([(int(askers[row[x]]), to_bytes(tokens[x:y]), total[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:])], columns=ANSWER.names)

        return asks.groupBy("scope").applyInPandas(reply, ANSWER)

    inner = width // FAN

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        tokens, _, first, total, owner = gathered(frame, groups)
        asker = (int(frame["scope"].iloc[0]) << 32) + int(frame["bundle"].iloc[0])
        return pd.DataFrame(split(asker, tokens[first], np.minimum(total, 2**32 - 1), owner if groups else None, ranges, inner), columns=ASK.names)

    def hand_on(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(answers):
            tokens, count = sorted_answers(answers)
            for asker, raw in zip(frame["asker"], frame["tokens"]):
                own = from_bytes(raw)
                found = lookup(own, tokens, count, 0)
                if (hit := found > 0).any():
                    out.append((asker, to_bytes(own[hit]), found[hit].astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=ANSWER.names)

    keys = ["scope", "bundle"]
    bundled = asks.withColumn("bundle", F.pmod(F.xxhash64("asker"), F.lit(width)))
    found = exchange(bundled.groupBy(*keys).applyInPandas(merge, ASK), groups, ranges, inner)
    found = found.select(F.shiftright("asker", 32).alias("scope"), F.col("asker").bitwiseAND(F.lit(2**32 - 1)).alias("bundle"), "tokens", "counts")
    return bundled.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInPandas(hand_on, ANSWER)


def sorted_answers(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    tokens = np.concatenate([np.zeros(0, np.uint64), *(from_bytes(t) for t in frame["tokens"])])
    order = np.argsort(tokens)
    return tokens[order], np.frombuffer(b"".join(frame["counts"]), np.uint32).astype(np.int64)[order]


def with_frequencies(rows: DataFrame, parts: int, groups: bool, fn: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """fn(rows of a block, tokens, frequencies) for blocks of rows (cid, grp, tokens, ...).

    The tokens are those of the block that occur in two groups or more, sorted; a frequency is the number of groups,
    summed over blocks. With groups=False every row is a group of its own. Blocks are dealt by a hash of cid; each
    sends its distinct tokens, cut into ranges, and gets the shared ones back (exchange()).
    """
    width = 1
    while width * FAN < parts:
        width *= FAN
    ranges = -(-parts // width) * width
    placed = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(parts))).repartition("block")

    def send(frame: pd.DataFrame) -> pd.DataFrame:
        free_caches()
        own = [from_bytes(t) for t in frame["tokens"]]
        tokens = np.concatenate(own)
        owner = np.repeat(frame["grp"].to_numpy(np.int64), [len(t) for t in own]) if groups else None
        del own
        if groups:
            order = np.lexsort((owner, tokens))
            tokens, owner = tokens[order], owner[order]
            new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])))
            tokens, owner = tokens[new], owner[new]
        else:
            tokens.sort()
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        count = np.diff(np.concatenate((first, [len(tokens)])))
        if groups:
            owner = np.where(count == 1, owner[first], MIXED)
        return pd.DataFrame(split(int(frame["block"].iloc[0]), tokens[first], count, owner, ranges, width), columns=ASK.names)

    def receive(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        return fn(frame, *sorted_answers(answers))

    answers = exchange(placed.groupBy("block").applyInPandas(send, ASK), groups, ranges, width)
    return placed.groupBy("block").cogroup(answers.groupBy("asker")).applyInPandas(receive, schema)


def lookup(own: np.ndarray, tokens: np.ndarray, count: np.ndarray, other: int = 1) -> np.ndarray:
    """The frequency of each of own; `other` if it isn't among tokens."""
    if not len(tokens):
        return np.full(len(own), other, np.int64)
    at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
    return np.where(tokens[at] == own, count[at], other)


KEPT = T.StructType([T.StructField(c, T.LongType()) for c in ("cid", "key", "th", "free")])


def sharing_classes(classes: DataFrame, parts: int, percent: int) -> DataFrame:
    """KEPT: the classes (cid, key, th, n, tokens) of which a first token occurs in another one."""

    def choose(frame: pd.DataFrame, tokens: np.ndarray, count: np.ndarray) -> pd.DataFrame:
        out = []
        for cid, key, th, n, raw in zip(frame["cid"], frame["key"], frame["th"], frame["n"], frame["tokens"]):
            own = from_bytes(raw)
            shared = lookup(own, tokens, count) > 1
            band, need = int(np.searchsorted(own, LOW)), slack(int(n), percent) + 1
            free = band - int(shared[:band].sum())
            if free < need and (shared[:band].any() or shared[band : band + need - free].any()):
                out.append((cid, key, th, free))
        return pd.DataFrame(out, columns=KEPT.names)

    return with_frequencies(classes, parts, False, choose, KEPT)


ENTRY = T.StructType([T.StructField(c, T.LongType()) for c in ("sig", "cid", "grp", "n", "cap")])


def least_sizes(percent: int) -> list[int]:
    """The size from which sets use each of LEVELS; up to the next one's / percent they do."""
    return [max(2 * m, -(-100 * (m + 2) // percent)) if m else 0 for m in LEVELS]


def signatures(own: np.ndarray, count: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, int]:
    """The signatures of a set, and how many of its tokens occur in another group (none: no signatures)."""
    cap = int((count > 1).sum())
    need = slack(n, percent) + 1 - (n - cap)
    none = np.zeros(0, np.uint64)
    # the largest partner that cap matching tokens allow must not be too small
    if need <= 0 or cap * (100 + percent) // percent - n < -(-percent * n // 100):
        return none, cap
    own, count = own[count > 1], count[count > 1]
    order = np.lexsort((own, count))
    own, count = own[order], count[order]
    out, least = [none], least_sizes(percent)
    rare = int((count <= RARE).sum())
    with np.errstate(over="ignore"):
        for level, kinds in enumerate(LEVELS):
            if n < least[level] or (level + 1 < len(LEVELS) and percent * n >= 100 * least[level + 1]):
                continue
            single = lambda tokens, tag=np.uint64(2 * level): mix(tokens * np.uint64(16) + tag)
            if not kinds or rare >= need:
                out.append(single(own[:need]))
                continue
            out.append(single(own[:rare]))
            kind = own[rare:] % np.uint64(kinds)
            seen, broken, last = set(), rare, len(kind)
            for i, k in enumerate(kind.tolist()):
                if k in seen:
                    broken += 1
                    if broken >= need:
                        last = i + 1
                        break
                seen.add(k)
            # tokens by class and value; each with those after it in its class
            kind, part = kind[:last], own[rare : rare + last]
            order = np.lexsort((part, kind))
            kind, part = kind[order], part[order]
            for step in range(1, len(part)):
                same = kind[step:] == kind[:-step]
                if not same.any():
                    break
                out.append(mix(mix(part[:-step][same]) * np.uint64(16) + mix(part[step:][same] + np.uint64(2 * level + 1))))
    return np.unique(np.concatenate(out)), cap


def index_entries(rows: DataFrame, parts: int, percent: int) -> DataFrame:
    """ENTRY rows of the classes (cid, grp, n, tokens)."""

    def build(frame: pd.DataFrame, tokens: np.ndarray, count: np.ndarray) -> pd.DataFrame:
        sigs, heads = [], []
        for cid, grp, n, raw in zip(frame["cid"], frame["grp"], frame["n"], frame["tokens"]):
            own = from_bytes(raw)
            found, cap = signatures(own, lookup(own, tokens, count), int(n), percent)
            if len(found):
                sigs.append(found.view(np.int64))
                heads.append((cid, grp, n, cap))
        if not sigs:
            return pd.DataFrame([], columns=ENTRY.names)
        sizes = [len(s) for s in sigs]
        columns = {c: np.repeat(np.array(v, np.int64), sizes) for c, v in zip(ENTRY.names[1:], zip(*heads))}
        return pd.DataFrame({"sig": np.concatenate(sigs)} | columns)

    return with_frequencies(rows, parts, True, build, ENTRY)


def other(entries: DataFrame, *keys: str) -> DataFrame:
    """entries as the other side of a join on keys: all other columns with _."""
    return entries.select(*keys, *[F.col(c).alias(c + "_") for c in entries.columns if c not in keys])


def allowed(percent: int):
    """Whether an entry and another one (columns with _) are of different groups and may link, by sizes and free tokens."""
    sizes = (100 * F.least("n", "n_") >= percent * F.greatest("n", "n_")) & (F.least("cap", "cap_") * (100 + percent) >= percent * (F.col("n") + F.col("n_")))
    return (F.col("grp") != F.col("grp_")) & sizes


def centres(entries: DataFrame) -> DataFrame:
    """For each signature of two groups and more, the entry with the least free tokens (columns with _)."""
    least = F.min(F.struct((F.col("n") - F.col("cap")).alias("free"), *ENTRY.names[1:])).alias("c")
    found = entries.groupBy("sig").agg(least, F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi")
    return found.select("sig", *[F.col(f"c.{c}").alias(c + "_") for c in ENTRY.names[1:]])


def central_pairs(entries: DataFrame, central: DataFrame, percent: int) -> DataFrame:
    """(a, b): each class and the centres of its signatures, where allowed: at most a pair for each entry."""
    return entries.join(central.hint("merge"), "sig").where(allowed(percent)).select(F.col("cid").alias("a"), F.col("cid_").alias("b")).distinct()


def regrouped(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """entries with the groups (cid, comp), without signatures of one group, and m, the number of a signature's entries."""
    found = entries.drop("grp").join(groups.withColumnRenamed("comp", "grp"), "cid", "left").withColumn("grp", F.coalesce("grp", "cid")).select(*ENTRY.names)
    useful = found.groupBy("sig").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("sig", "m")
    return found.join(useful, "sig")


def candidates(index: DataFrame, sets: DataFrame, percent: int, stage: Callable[[DataFrame, str], tuple[DataFrame, str]]) -> DataFrame:
    """(a, b): classes of different groups with a common signature, where allowed and plausible.

    Entries of a crowded signature have their sets' parities with them, so that classes that only share what many share
    make no rows; pairs of other signatures, at most CROWD / 2 for each entry, look the parities up.
    """
    few = index.where(F.col("m") <= CROWD).drop("m")
    pairs = few.join(other(few, "sig").hint("merge"), "sig").where(allowed(percent) & (F.col("grp") < F.col("grp_")))
    many, _ = stage(crowded(index.where(F.col("m") > CROWD), sets), "crowded")
    kinds = many.groupBy("sig", "mask").agg(F.lit(1).alias("one")).drop("one")
    # which parts of a posting meet: those without a leading signature in common
    meet = kinds.join(kinds.select("sig", F.col("mask").alias("mask_")), "sig").where("mask <= mask_ and mask & mask_ = 0")
    apart = many.join(meet, ["sig", "mask"]).join(other(many, "sig", "mask").withColumnRenamed("mask", "mask_").hint("merge"), ["sig", "mask_"])
    apart = apart.where(allowed(percent) & ((F.col("mask") < F.col("mask_")) | (F.col("grp") < F.col("grp_"))) & near_parities(percent))
    ends = [F.least("cid", "cid_").alias("a"), F.greatest("cid", "cid_").alias("b")]
    return plausible(pairs.select(*ends).distinct(), sets, percent).unionByName(apart.select(*ends)).distinct()


def crowded(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """ENTRY rows with their sets' parities and mask: which of its signature's LEADERS a class has.

    Signatures have a global order, the most frequent first. A signature's leaders are the first signatures of one of its
    classes (that of the least free tokens), as far as they come before it. Two classes that both have a leader share a
    signature earlier in that order, and a pair's first common signature has no leader that both have: so a pair whose
    masks have a bit in common may be left out here, and is found at its first one at the latest.
    """
    place = F.struct((-F.col("m")).alias("m"), "sig")
    first = entries.groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(place)), 1, LEADERS).alias("first"))  # a class's own signatures
    heads = entries.groupBy("sig").agg(F.min_by("cid", F.struct(F.col("n") - F.col("cap"), "cid")).alias("cid"), F.first("m").alias("m")).join(first, "cid")
    leaders = F.transform(F.filter("first", lambda x: x < place), lambda x: x["sig"])
    padded = F.slice(F.concat(leaders, F.array_repeat(F.lit(NO_LEADER), LEADERS)), 1, LEADERS)
    marked = entries.join(heads.select("sig", padded.alias("leaders")), "sig")
    # the signatures of a class together, again
    by_class = marked.groupBy("cid", "grp", "n", "cap").agg(F.collect_list(F.struct("sig", "leaders")).alias("own")).join(sets.select("cid", *SKETCH).hint("merge"), "cid")
    rows = by_class.select("cid", "grp", "n", "cap", F.col("own.sig").alias("sigs"), F.flatten("own.leaders").alias("leaders"), *SKETCH)
    schema = T.StructType([*ENTRY.fields, T.StructField("mask", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in SKETCH]])
    bit = 1 << np.arange(LEADERS)

    rows_columns = rows.columns

    def run(batch: pa.RecordBatch) -> dict:
        sigs = [x.values.to_numpy(zero_copy_only=False) for x in batch.column(4)]
        leaders = [x.values.to_numpy(zero_copy_only=False) for x in batch.column(5)]
        masks = [np.isin(y, x).reshape(-1, LEADERS) @ bit for x, y in zip(sigs, leaders)]
        sizes = [len(x) for x in sigs]
        out = {c: np.repeat(batch.column(i).to_numpy(), sizes) for i, c in enumerate(rows_columns) if c not in ("sigs", "leaders")}
        return {"sig": np.concatenate(sigs)} | out | {"mask": np.concatenate(masks)}

    return map_batches(rows, run, schema)


def near_parities(percent: int):
    """Whether the parities of an entry and another one (columns with _) allow the threshold.

    |A xor B| <= (|A| + |B|)(100 - percent) / (100 + percent) says the same as the threshold; the number of parities that
    differ is a lower bound of it.
    """
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + "_"))) for c in SKETCH), F.lit(0))
    return differ * (100 + percent) <= (F.col("n") + F.col("n_")) * (100 - percent)


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities allow the threshold."""
    one, two = sets.select(F.col("cid").alias("a"), "n", *SKETCH), sets.select(F.col("cid").alias("b"), *[F.col(c).alias(c + "_") for c in ("n", *SKETCH)])
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(near_parities(percent)).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their full sets."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        out = {"a": [], "b": []}
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = from_bytes(x), from_bytes(y)
            if len(x) > len(y):
                x, y = y, x
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                out["a"].append(a)
                out["b"].append(b)
        return out

    one = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x")).hint("merge"), "a")
    both = one.join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y")).hint("merge"), "b")
    return map_batches(both.select("a", "b", "x", "y"), run, schema)


def star_pairs(sets: DataFrame, percent: int, stage: Callable[[DataFrame, str], tuple[DataFrame, str]]) -> DataFrame:
    """(a, b): classes and the class of the least free tokens among those with equal minima, if they agree AGREED times."""
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("n", T.LongType()), T.StructField("free", T.LongType()), T.StructField("minimum", T.LongType())])
    seeds = mix(np.arange(1, STARS + 1, dtype=np.uint64))

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for raw in batch.column(3).to_pylist():
            own = from_bytes(raw)
            out.append(np.array([mix(own ^ s).min() for s in seeds]) ^ seeds)
        return {"cid": np.repeat(batch.column(0).to_numpy(), STARS), "n": np.repeat(batch.column(1).to_numpy(), STARS), "free": np.repeat(batch.column(2).to_numpy(), STARS), "minimum": np.concatenate(out).view(np.int64)}

    rows = map_batches(sets.select("cid", "n", "free", "tokens"), run, schema)
    rows, _ = stage(rows, "minima")
    centre, _ = stage(rows.groupBy("minimum").agg(F.min(F.struct("free", "cid", "n")).alias("c"), F.count("*").alias("m")).where("m > 1").select("minimum", "c"), "centres")
    met = rows.join(centre, "minimum").where("cid <> c.cid").where(100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n"))
    return met.groupBy(F.col("cid").alias("a"), F.col("c.cid").alias("b")).agg(F.count("*").alias("k")).where(F.col("k") >= AGREED).select("a", "b")


def components(links: DataFrame, stage: Callable[[DataFrame, str], tuple[DataFrame, str]]) -> DataFrame:
    """(cid, comp) of every node of links (a, b), by alternating large and small stars; comp is the smallest node.

    Each round is written to the shared folder; the driver only sees a count and a checksum of the links.
    """
    spark = links.sparkSession
    edges, path = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    last = mark(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges, new = stage(small, "links")
        drop_table(spark, path)
        release_shuffles(spark)
        path = new
        now = mark(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("cid")).distinct().select("cid", F.col("cid").alias("comp"))
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp")).unionByName(roots)


def parts_of(table: DataFrame, column: str) -> int:
    return max(1, -(-(table.agg(F.sum(F.length(column))).first()[0] or 0) // BLOCK))


def linked(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(key, th, n, cid) of every row, and (cid, head, low) of classes with links: structs (key, th) of each one's first
    document and its component's."""
    spark = docs.sparkSession
    stage = stage_table

    def drop(path: str) -> None:
        drop_table(spark, path)
        release_shuffles(spark)

    shingled, shingled_path = stage(shingle_table(docs, words, percent), "shingles")
    rows, _ = stage(shingled.select("key", "th", "n", "cid"), "rows")
    classes = shingled.where("n > 0").groupBy("cid").agg(F.min(F.struct("key", "th")).alias("head"), F.first("n").alias("n"), F.first("low").alias("tokens")).select("cid", "head.*", "n", "tokens")
    kept, kept_path = stage(sharing_classes(classes, parts_of(shingled, "low"), percent), "kept")
    del classes, shingled
    drop(shingled_path)
    sets, sets_path = stage(full_sets(docs, kept, words), "sets")
    drop(kept_path)
    stars, _ = stage(verify(star_pairs(sets, percent, stage), sets, percent), "stars")
    release_shuffles(spark)
    groups, _ = stage(components(stars, stage), "groups")
    grouped = sets.select("cid", "n", "tokens").join(groups.withColumnRenamed("comp", "grp"), "cid", "left").withColumn("grp", F.coalesce("grp", "cid"))
    entries, entries_path = stage(index_entries(grouped, parts_of(sets, "tokens"), percent), "index")
    del grouped
    release_shuffles(spark)
    # tables of their own, so that the joins deal by signature anew and can split a common one
    central, central_path = stage(centres(entries), "centres")
    near, near_path = stage(plausible(central_pairs(entries, central, percent), sets, percent), "near")
    found, _ = stage(verify(near, sets, percent), "near")
    stars = stars.unionByName(found)
    drop(central_path)
    drop(near_path)
    groups, _ = stage(components(stars, stage), "groups")
    index, index_path = stage(regrouped(entries, groups), "index")
    drop(entries_path)
    pairs, pairs_path = stage(candidates(index, sets, percent, stage), "pairs")
    drop(index_path)
    more, _ = stage(verify(pairs, sets, percent), "more")
    for path in (pairs_path, sets_path):
        drop(path)
    found = components(stars.unionByName(more), stage)
    # each class's first document, and each component's
    first = rows.where("cid is not null").groupBy("cid").agg(F.min(F.struct("key", "th")).alias("head"))
    near = first.join(found, "cid")
    low = near.join(near.groupBy("comp").agg(F.min("head").alias("low")), "comp").select("cid", "head", "low")
    alone = first.join(found, "cid", "left_anti").select("cid", "head", F.col("head").alias("low"))
    classes, _ = stage(low.unionByName(alone), "components")
    return rows, classes


def link_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    rows, classes = linked(docs, words, percent)
    back = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return rows.join(classes.select("cid", F.col("low.key").alias("low")), "cid", "left").select(back("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(back("low"), back("key")).alias("component_id"))


def first_of_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the document with the smallest id (then the smallest digest of its text), with all its columns;
    texts without words all stay. Of rows with equal id and text any one stays.

    What stays is told by id and text, not by id alone. docs' columns travel as one struct, so their names do not matter.
    """
    rows, classes = linked(docs, words, percent)
    kept = classes.where("head = low").select("head.*").unionByName(rows.where("cid is null").select("key", "th").distinct())
    kept, _ = stage_table(kept, "first")
    unique = keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).groupBy("key", "th").agg(F.first("row").alias("row"))
    return unique.join(kept.hint("merge"), ["key", "th"], "left_semi").select("row.*")


def oracle(words: int = 4, percent: int = 85) -> str:
    """DuckDB SQL for link_components() of the table documents with distinct ids: all pairs with a common shingle, and all that is reached."""
    shingle = ", ".join(f"words[i + {j}]" for j in range(words))
    return rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (select doc_id, case when len(words) = 0 then [] when len(words) < {words} then [array_to_string(words, ' ')]
  else list_distinct(list_transform(range(1, len(words) - {words - 2}), lambda i: concat_ws(' ', {shingle}))) end as shingles from w),
n as (select doc_id, len(shingles) as n, list_sort(shingles) as own from s),
classes as (select min(doc_id) as c, own, n from n where n > 0 group by own, n),
x as (select c, n, unnest(own) as g from classes),
pairs as (select a.c as a, b.c as b from x a join x b on a.g = b.g and a.c < b.c where 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  group by a.c, b.c, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reach as (select c as a, c as b from classes union select reach.a, links.b from reach join links on reach.b = links.a),
low as (select a as c, min(b) as component_id from reach group by 1)
select n.doc_id, cast(n.n as bigint) as n_shingles, coalesce(low.component_id, n.doc_id) as component_id
from n left join classes on n.own = classes.own and n.n > 0 left join low on classes.c = low.c
"""
