"""Problem 8: long exact spans shared between records.

Method: suffix automata of reference shards, past which documents are streamed for matching statistics; maximal
matches of at least SPAN characters are the shared spans. Broadcasting the automata of all shards to all documents
costs the square of the corpus, so shards and documents are brought together by anchors instead:

1. Texts that are exact copies are put into classes; only one of each goes on.
2. Anchors (winnowing): in every SPAN characters at least one substring of ANCHOR characters is chosen, by its
   hash, so that two texts with a span in common have an anchor in it in common. They are found by vectorised
   rolling hashes; about 1 in 50 characters begins one. Anchors of one document alone are dropped.
3. The document with the smallest id that holds an anchor is the anchor's reference; the surroundings of its shared
   anchors, SHARD_CHARS characters of the document at a time, are a reference shard. Every other document is
   streamed past the automata of the shards it has anchors of, and only with the surroundings of those.
4. The matching statistics tell how far an anchor's match with its reference extends to both sides. Two documents that
   leave the reference at different places match each other exactly as far as the shorter of the two reaches, so the
   extents alone give the sets of documents that share SPAN characters, by the distinct left extents of an anchor. Only
   documents that leave the reference at the same place as another one may go on alike: for those, and where an anchor
   stands twice in a document, the windows of SPAN characters around the anchor are compared by 128-bit digests, which
   is exact in any case.

A reference goes to a task once for each MOST_PIECES pieces streamed past it, and rows of anchors, shards and copies that very
many documents hold are dealt by salt. The work follows the text, the shared text and the classes; no pair is made before
the classes, which come out once each, are known (``p8_classes`` has them, with each document's number of links).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.runtime import hot_bound, salted_join, spread, staged, table

#: Least length of a shared span, and length of an anchor, in characters (code points).
SPAN, ANCHOR = 200, 100
#: Characters of one document in a reference shard.
SHARD_CHARS = 20_000
#: Pieces that one task streams past one reference shard, about.
MOST_PIECES = 2_000

_CHUNK = 1 << 19  # characters hashed at once
_POSITION = (1 << 20) - 1
_FACTOR = 0x9E3779B97F4A7C15
_FACTORS = (_FACTOR, 0xD6E8FEB86659FD93)


def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """factor ** i and factor ** -i modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        up = np.full(n, factor, dtype=np.uint64)
        down = np.full(n, pow(factor, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


class Hasher:
    """Rolling hashes of all substrings of one length."""

    def __init__(self, factor: int = _FACTOR) -> None:
        self.up, self.down = _powers(factor, _CHUNK + 2 * SPAN)

    def windows(self, codes: np.ndarray, width: int) -> np.ndarray:
        n = len(codes)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * self.down[:n], out=total[1:])
        h = (total[width:] - total[:-width]) * self.up[: n - width + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def winnow(hasher: Hasher, pieces: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of ``(text number, offset, code points)``, together at most _CHUNK long: text number, place, hash."""
    codes = np.concatenate([p[2] for p in pieces])
    lengths = np.array([len(p[2]) for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), lengths)
    if len(codes) < SPAN:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    h = hasher.windows(codes, ANCHOR)
    ranked = (h & ~np.uint64(_POSITION)) | (np.uint64(_POSITION) - np.arange(len(h), dtype=np.uint64))  # the last of equals
    least = _sliding_min(ranked, SPAN - ANCHOR + 1)
    inside = piece[: len(least)] == piece[SPAN - 1 :]
    at = np.unique(_POSITION - (least[inside] & np.uint64(_POSITION)).astype(np.int64))
    start = np.r_[0, np.cumsum(lengths)[:-1]]
    own = piece[at]
    text = np.array([p[0] for p in pieces])[own]
    offset = np.array([p[1] for p in pieces])[own]
    return text, at - start[own] + offset, h[at]


def _chunks(texts: list[str]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Texts in groups of at most _CHUNK characters; a longer text in pieces that overlap by a window."""
    group, size = [], 0
    for k, text in enumerate(texts):
        codes = codes_of(text)
        for offset in range(0, max(1, len(codes) - SPAN + 1), _CHUNK // 2):
            part = codes[offset : offset + _CHUNK // 2 + SPAN - 1]
            if group and size + len(part) > _CHUNK:
                yield group
                group, size = [], 0
            group.append((k, offset, part))
            size += len(part)
    if group:
        yield group


def anchors_of(hasher: Hasher, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of the anchors of all texts, each place once."""
    found = [winnow(hasher, group) for group in _chunks(texts)]
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.int64),)
    text, place, h = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, text))
    text, place, h = text[order], place[order], h[order].view(np.int64)
    fresh = np.r_[True, (text[1:] != text[:-1]) | (place[1:] != place[:-1])] if len(text) else np.zeros(0, dtype=bool)
    return text[fresh], place[fresh], h[fresh]


def _slabs(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Rows in groups of bounded text, so that a batch of long texts takes no more memory than one of short ones."""
    a = size = 0
    for b, text in enumerate(texts):
        size += len(text)
        if size > 2 * _CHUNK:
            yield ids[a : b + 1], texts[a : b + 1]
            a, size = b + 1, 0
    if a < len(ids):
        yield ids[a:], texts[a:]


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for ids, texts in _slabs(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text, place, h = anchors_of(hasher, texts)
            order = np.lexsort((place, h, text))
            text, place, h = text[order], place[order], h[order]
            first = np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])] if len(text) else np.zeros(0, dtype=bool)
            starts = np.flatnonzero(first)
            many = np.diff(np.r_[starts, len(text)]) > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[starts]), pa.array(np.array(ids, dtype=np.int64)[text[starts]]), pa.array(place[starts].astype(np.int32)), pa.array(many)],
                names=["anchor", "doc", "pos", "many"],
            )


class SuffixAutomaton:
    """The suffix automaton of one or more texts; between two texts stands a symbol that no text can match."""

    def __init__(self, texts: list[str]) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for k, text in enumerate(texts):
            if k:
                last = self._extend(last, ("end", k))
            for symbol in text:
                last = self._extend(last, symbol)

    def _extend(self, last: int, symbol) -> int:
        nexts, link, length = self.next, self.link, self.length
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new

    def matching_statistics(self, text: str) -> list[int]:
        """For each place the length of the longest substring ending there that occurs in the reference."""
        nexts, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for symbol in text:
            to = nexts[state].get(symbol)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nexts[state].get(symbol)
            if to is None:
                matched = 0
            else:
                state = to
                matched += 1
            out.append(matched)
        return out


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``doc, text, live`` the surroundings of a document's shared anchors, by reference shard."""
    for batch in batches:
        rows = []
        for doc, text, live in zip(*(batch.column(k).to_pylist() for k in range(3))):
            by_shard: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for x in live:
                by_shard.setdefault((x["home"], x["shard"]), []).append((x["pos"], x["anchor"]))
            for (home, shard), places in by_shard.items():
                places.sort()
                a = b = -1
                inside: list[tuple[int, int]] = []
                for pos, anchor in places:
                    begin, end = max(0, pos - (SPAN - ANCHOR)), min(len(text), pos + SPAN)
                    if begin > b:
                        if inside:
                            rows.append((home, shard, doc, text[a:b], [p - a for p, _ in inside], [x for _, x in inside]))
                        a, inside = begin, []
                    b = end
                    inside.append((pos, anchor))
                rows.append((home, shard, doc, text[a:b], [p - a for p, _ in inside], [x for _, x in inside]))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["home", "shard", "doc", "piece", "places", "anchors"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``home, shard, doc, piece, places, anchors`` how far each anchor's match extends; -1: not told.

    Rows come sorted by shard, the pieces of its reference (doc = home) first.
    """
    shard, reference, automaton = None, [], None
    for batch in batches:
        out = []
        for home, number, doc, piece, places, anchors in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if shard != (home, number):
                shard, reference, automaton = (home, number), [], None
            if doc == home:
                reference.append(piece)
                continue
            if automaton is None:
                automaton = SuffixAutomaton(reference)
            statistics = automaton.matching_statistics(piece)
            for place, anchor in zip(places, anchors):
                end = place + ANCHOR - 1
                left = statistics[end] - ANCHOR
                if left >= 0:
                    stop = min(len(piece), place + SPAN)
                    while end + 1 < stop and end + 1 - statistics[end + 1] < place:
                        end += 1
                    if place - (end - statistics[end] + 1) != left:  # the two sides match at different places
                        left = -1
                out.append((anchor, doc, min(left, SPAN - ANCHOR), end + 1 - place if left >= 0 else -1))
        columns = list(zip(*out)) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["anchor", "doc", "before", "after"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``doc, text, wanted`` the digests of all windows of SPAN characters that hold a wanted anchor, and where they are."""
    hasher, second = Hasher(), Hasher(_FACTORS[1])
    for batch in batches:
        for doc, text, wanted in zip(*(batch.column(k).to_pylist() for k in range(3))):
            _, place, h = anchors_of(hasher, [text])
            place = place[np.isin(h, np.array(wanted, dtype=np.int64))]
            mark = np.zeros(len(text) + 2, dtype=np.int64)
            np.add.at(mark, np.maximum(0, place - (SPAN - ANCHOR)), 1)
            np.add.at(mark, np.minimum(place, len(text) - SPAN) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[: len(text) - SPAN + 1])
            for at in range(0, len(starts), _CHUNK // 4):
                some = starts[at : at + _CHUNK // 4]
                base, codes = some[0], None
                keys = [[], []]
                for a in range(int(base), int(some[-1]) + 1, _CHUNK // 2):
                    codes = codes_of(text[a : a + _CHUNK // 2 + SPAN - 1])
                    here = some[(some >= a) & (some < a + _CHUNK // 2)] - a
                    for k, x in enumerate((hasher, second)):
                        keys[k].append(x.windows(codes, SPAN)[here].view(np.int64))
                one, two = (np.concatenate(k) for k in keys)
                order = np.lexsort((some, two, one))
                one, two, place_ = one[order], two[order], some[order]
                # windows of equal text that touch are one stretch: a periodic text gives one row for each phase
                fresh = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (np.diff(place_) > SPAN)]
                first = np.flatnonzero(fresh)
                last = np.r_[first[1:], len(fresh)] - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[first]), pa.array(two[first]), pa.array(np.full(len(first), doc, dtype=np.int64)), pa.array(place_[first].astype(np.int32)), pa.array((place_[last] + SPAN).astype(np.int32))],
                    names=["one", "two", "doc", "start", "end"],
                )


class SharedSpans:
    """The classes of documents that share a span, and where. All frames are staged tables."""

    def __init__(self, df: DataFrame, id_column: str, text: str) -> None:
        docs = df.where(F.col(id_column).isNotNull() & (F.length(text) >= SPAN)).select(F.col(id_column).cast("long").alias("doc"), F.col(text).alias("text"))
        # 1. classes of equal texts, each represented by its smallest id
        keyed = docs.select("doc", F.unhex(F.md5("text")).alias("key"))
        least = staged(keyed.groupBy("key").agg(F.min("doc").alias("rep"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")).where("rep < last").select("key", "rep", "n"))
        self.copies = staged(salted_join(keyed, least, ["key"], "n", F.col("doc")).select("doc", "rep").distinct())
        others = self.copies.where("doc <> rep").select("doc")
        # 2. anchors
        anchors = staged(spread(docs).mapInArrow(_find_anchors, "anchor long, doc long, pos int, many boolean").join(others, "doc", "left_anti"))
        held = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"), F.min(F.struct("doc", "pos")).alias("home"), F.max("many").alias("many"))
        held = staged(held.where("home.doc < last").select("anchor", "n", "many", F.col("home.doc").alias("home"), F.floor(F.col("home.pos") / SHARD_CHARS).cast("int").alias("shard")))
        shared = staged(salted_join(anchors.drop("many"), held, ["anchor"], "n", F.col("doc")).select("anchor", "doc", "pos", "many", "home", "shard").distinct())  # a repeated row is one document
        # 3. surroundings of shared anchors, past the automata of their shards
        live = shared.where("NOT many").groupBy("doc").agg(F.collect_list(F.struct("home", "shard", "pos", "anchor")).alias("live"))
        pieces = staged(
            docs.join(live, "doc").select("doc", "text", "live").mapInArrow(_slice, "home long, shard int, doc long, piece string, places array<int>, anchors array<long>").distinct()
        )
        self.reach = staged(self._met(pieces).mapInArrow(_stream, "anchor long, doc long, before int, after int"))
        # 4. who shares a span: by extents, and by windows where two documents leave the reference at the same place
        whole = shared.where("NOT many AND doc = home").select("anchor", "doc", F.lit(SPAN - ANCHOR).alias("before"), F.lit(SPAN).alias("after"), F.lit(True).alias("is_home"))
        told = self.reach.where("before >= 0").select("anchor", "doc", "before", "after", F.lit(False).alias("is_home"))
        self.extents = staged(whole.unionByName(told))
        alike = []
        for side, most in (("before", SPAN - ANCHOR), ("after", SPAN)):
            left = self.extents.where(~F.col("is_home") & (F.col(side) < most))
            n = staged(left.groupBy("anchor", side).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
            alike.append(salted_join(left, n, ["anchor", side], "n", F.col("doc")).select("anchor", "doc"))
        # of an anchor whose match isn't told in some document, all documents are compared
        untold = self.reach.where("before < 0").select("anchor").unionByName(shared.where("many").select("anchor")).groupBy("anchor").agg(F.lit(True).alias("untold"))
        n = staged(untold.join(held.select("anchor", "n"), "anchor").select("anchor", "n"))
        every = salted_join(shared.select("anchor", "doc"), n, ["anchor"], "n", F.col("doc"))
        unclear = alike[0].unionByName(alike[1]).unionByName(every.select("anchor", "doc")).groupBy("doc").agg(F.collect_set("anchor").alias("wanted"))
        windows = staged(docs.join(unclear, "doc").select("doc", "text", "wanted").mapInArrow(_windows, "one long, two long, doc long, start int, end int").distinct())
        found = staged(windows.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last").select("one", "two", "n"))
        self.windows = staged(salted_join(windows, found, ["one", "two"], "n", F.col("doc")).select("one", "two", "doc", "start", "end"))
        self.shared = shared

    @staticmethod
    def _met(pieces: DataFrame) -> DataFrame:
        """References and pieces brought together by shard, the reference first; a shard of very many pieces is dealt."""
        shard = ["home", "shard"]
        n = staged(pieces.where("doc <> home").groupBy(*shard).agg(F.count(F.lit(1)).alias("n")))
        bound = hot_bound(n, "n", MOST_PIECES)
        parts = F.ceil(F.col("n") / bound).cast("int")
        crowded = F.broadcast(n.where(F.col("n") >= bound).select(*shard, (parts + 1).alias("parts")))
        dealt = pieces.where("doc <> home").join(crowded, shard, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        given = n.select(*shard, F.explode(F.when(F.col("n") >= bound, F.sequence(F.lit(0), parts)).otherwise(F.array(F.lit(0)))).alias("part"))
        references = pieces.where("doc = home").join(given, shard)
        union = references.select("home", "shard", "part", "doc", "piece", "places", "anchors").unionByName(dealt)
        sorted_ = union.repartition(*shard, "part").sortWithinPartitions(*shard, "part", F.col("doc") != F.col("home"))
        return sorted_.select("home", "shard", "doc", "piece", "places", "anchors")

    def _members(self) -> DataFrame:
        """``key, doc``: sets of distinct texts of which any two share a span, told by extents.

        For each left extent x that a document of the anchor has: all that reach x to the left and SPAN - x to the right.
        Any two of these share SPAN characters, and of any two that do so by their extents, the one with the smaller left
        extent x gives a set that holds both. Sets of one document are dropped later.
        """
        steps = self.extents.groupBy("anchor").agg(F.array_sort(F.collect_set("before")).alias("steps"), F.count(F.lit(1)).alias("n"))  # at most 101 numbers
        met = salted_join(self.extents, staged(steps), ["anchor"], "n", F.col("doc"))
        reached = F.filter("steps", lambda x: (x <= F.col("before")) & (x >= SPAN - F.col("after")))
        return met.select("doc", "anchor", F.explode(reached).alias("step")).select(F.struct(F.col("anchor").alias("one"), F.col("step").cast("long").alias("two")).alias("key"), "doc")

    def classes(self) -> DataFrame:
        """``class, doc``: sets of documents that share a span with each other, each set once, copies included."""
        by_window = self.windows.select(F.struct("one", "two").alias("key"), "doc")
        members = staged(self._members().unionByName(by_window).distinct())
        # neighbouring anchors of one span have the same documents: one class for each set
        signature = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")).where("n > 1")
        once = staged(signature.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
        kept = salted_join(members, once, ["key"], "n", F.col("doc")).select(F.col("key").alias("class"), F.col("doc").alias("rep"))
        groups = self.copies.select("rep", "doc")
        spread = kept.join(groups, "rep", "left").select("class", F.coalesce("doc", "rep").alias("doc"))
        copies = groups.select(F.struct(F.col("rep").alias("one"), F.lit(-1).cast("long").alias("two")).alias("class"), "doc")
        return spread.unionByName(copies)

    def pairs(self) -> DataFrame:
        """``doc_lo, doc_hi``: the pairs of all classes, each once; the one place where the output grows as they do."""
        members = staged(self.classes())
        n = staged(members.groupBy("class").agg(F.count(F.lit(1)).alias("n")))
        # one side dealt, the other given to every part: no task pairs a large class by itself
        bound = hot_bound(n, "n")
        lows = salted_join(members, n.withColumn("parts", F.when(F.col("n") >= bound, F.ceil(F.col("n") / bound) + 1).otherwise(1).cast("int")), ["class"], "n", F.col("doc"), bound)
        lows = lows.select("class", F.col("doc").alias("doc_lo"), F.pmod(F.xxhash64("doc"), F.col("parts")).alias("part"))
        highs = members.join(F.broadcast(n.where(F.col("n") >= bound).select("class", (F.ceil(F.col("n") / bound) + 1).cast("int").alias("parts"))), "class", "left")
        highs = highs.select("class", F.col("doc").alias("doc_hi"), F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("parts", F.lit(1)) - 1).cast("long"))).alias("part"))
        return lows.join(highs, ["class", "part"]).where("doc_lo < doc_hi").select("doc_lo", "doc_hi").distinct()

    def spans(self) -> DataFrame:
        """``doc, start, end``: places of shared characters, overlapping ones of one document not yet merged."""
        # a document shares with its reference what its own extents tell, and the reference what the others' tell; what two
        # others share by their extents lies within that, or is found by their windows
        others = self.extents.where("NOT is_home").groupBy("anchor").agg(F.collect_set(F.struct("before", "after")).alias("reached"), F.count(F.lit(1)).alias("n"))
        met = salted_join(self.extents, staged(others), ["anchor"], "n", F.col("doc"))
        # extents that make a span of SPAN characters with this document's; a home counts the others only
        b, a = F.col("before"), F.col("after")
        mine = F.when(F.col("is_home"), F.col("reached")).otherwise(F.array(F.struct(b.alias("before"), a.alias("after"))))
        fits = F.filter(mine, lambda r: F.least(r["before"], b) + F.least(r["after"], a) >= SPAN)
        placed = met.select("anchor", "doc", F.explode(fits).alias("r")).join(self.shared.select("anchor", "doc", "pos"), ["anchor", "doc"])
        by_extent = placed.select("doc", (F.col("pos") - F.col("r.before")).alias("start"), (F.col("pos") + F.col("r.after")).alias("end"))
        return by_extent.unionByName(self.windows.select("doc", "start", "end"))

    def merged(self) -> DataFrame:
        """``doc, start, end``: the maximal stretches of each document that are shared elsewhere, in characters from 0."""
        order = Window.partitionBy("doc").orderBy("start", "end")  # the stretches of one document
        before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        marked = self.spans().select("doc", "start", "end", F.when(F.coalesce(before, F.lit(-1)) >= F.col("start"), 0).otherwise(1).alias("fresh"))
        numbered = marked.withColumn("stretch", F.sum("fresh").over(order))
        return numbered.groupBy("doc", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc", "start", "end")

    def covered(self) -> DataFrame:
        """``doc, shared_chars`` of the documents that share anything but whole copies."""
        return self.merged().groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias("shared_chars"))


def shared_pairs(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_lo, doc_hi`` of every pair of documents with SPAN or more consecutive characters in common.

    Characters are Unicode code points and must be exactly equal. NULL ids and texts and texts shorter than SPAN
    are in no pair; a text's own repetitions are none; rows with the same id are one document; copies are paired
    like any other documents; an empty table gives no rows; other columns are ignored. Texts are read whole.
    """
    return SharedSpans(df, id_column, text).pairs()


def shared_classes(df: DataFrame, id_column: str = "doc_id", text: str = "text", spans: SharedSpans | None = None) -> DataFrame:
    """``class, doc, links``: the sets of documents of which any two share a span, linear in their members.

    ``class`` is the smallest document of a set (sets may share it: two spans of one document), ``links`` how many others
    are in the set. A document has a row for each set it is in. Rows as in ``shared_pairs``.
    """
    spans = spans or SharedSpans(df, id_column, text)
    members = staged(spans.classes().select(F.col("class").alias("key"), "doc"))
    sizes = staged(members.groupBy("key").agg(F.min("doc").alias("class"), F.count(F.lit(1)).alias("n")))
    return salted_join(members, sizes.withColumn("links", F.col("n") - 1), ["key"], "n", F.col("doc")).select("class", "doc", "links")


def shared_amount(df: DataFrame, id_column: str = "doc_id", text: str = "text", spans: SharedSpans | None = None) -> DataFrame:
    """``doc, n_chars, shared_chars`` of every document: how many of its characters lie in spans shared elsewhere.

    A NULL text has 0 characters and shares none; ids that are NULL give no rows.
    """
    spans = spans or SharedSpans(df, id_column, text)
    base = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"))
    copied = spans.copies.select("doc", F.lit(True).alias("copied"))
    return (
        base.join(spans.covered(), "doc", "left")
        .join(copied, "doc", "left")
        .select("doc", "n_chars", F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("shared_chars", F.lit(0))).cast("long").alias("shared_chars"))
    )


def without_shared(df: DataFrame, id_column: str = "doc_id", text: str = "text", spans: SharedSpans | None = None) -> DataFrame:
    """``doc, text``: the documents without the maximal spans they share, the rest in order. Of documents that are copies
    as a whole the one with the smallest id keeps what it shares with no other text; the others are left empty.

    Documents that share nothing come out as they are, NULL texts stay NULL, ids that are NULL give no rows.
    """
    spans = spans or SharedSpans(df, id_column, text)
    cut = spans.merged().groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    later = spans.copies.where("doc <> rep").select("doc", F.lit(True).alias("later"))
    base = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc"), F.col(text).alias("text"))
    ends = F.concat(F.array(F.lit(0)), F.transform("cut", lambda s: s["end"]))
    starts = F.concat(F.transform("cut", lambda s: s["start"]), F.array(F.length("text")))
    left = F.array_join(F.zip_with(ends, starts, lambda a, b: F.substring(F.col("text"), a + 1, F.greatest(b - a, F.lit(0)))), "")
    joined = base.join(cut, "doc", "left").join(later, "doc", "left")
    return joined.select("doc", F.when(F.col("later") & F.col("text").isNotNull(), "").when(F.col("cut").isNotNull(), left).otherwise(F.col("text")).alias("text"))


def p8_shared(spark: SparkSession, root: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    return shared_amount(table(spark, root, "documents")).withColumnRenamed("doc", "doc_id")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """The pairs of documents that share a span of at least 200 characters."""
    return shared_pairs(table(spark, root, "documents"))


def p8_classes(spark: SparkSession, root: str) -> DataFrame:
    """The sets of documents that share a span, without their pairs."""
    return shared_classes(table(spark, root, "documents")).withColumnRenamed("doc", "doc_id")


_SQL_WINDOWS = """
WITH w AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id))"""
SQL = {
    "p8_found": _SQL_WINDOWS + """,
m AS (SELECT DISTINCT h, doc_id FROM w JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_lo, b.doc_id AS doc_hi FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_shared": _SQL_WINDOWS + """,
m AS (SELECT doc_id, least(200, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 200)) AS n FROM w JOIN s USING (h)),
c AS (SELECT doc_id, sum(n)::BIGINT AS shared_chars FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared_chars, 0) AS shared_chars FROM documents LEFT JOIN c USING (doc_id)""",
}
