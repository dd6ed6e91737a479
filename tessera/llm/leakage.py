"""Problem 4: passages of held-out test items in training conversations.

Method: prefix-filtered set join. A window of an item (12 consecutive words, or 20 consecutive Chinese
characters with digits) is a set of shingles (3 words, 4 characters). A text holds the window only if it holds
all its shingles, so the window's rarest shingle is a necessary prefix, and joining on that one alone loses
nothing. Rarity is counted over the whole corpus in a first pass; ordering shingles by it keeps the join small.
The place of the shingle in the window gives its place in the text: a candidate is discarded if the window
would begin before the text or end after it. What is left is verified word by word over the item-sized window.

Items of at most BLOCK_CHARACTERS altogether (their size is counted first) are one index, which is broadcast: some hundred
bytes a word. More items are joined by shuffle: their shingles, then their windows' prefixes, select by a bitmap of a fixed
size what of the corpus takes part; shingles are counted in one pass over the corpus, and a second one gives the places of
prefix shingles with the words around them, in which windows are verified. Either way the corpus is read twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.runtime import broadcast_object, received, salted_join, spread, staged, table

WORDS, CHARACTERS = 12, 20
SHINGLE_WORDS, SHINGLE_CHARACTERS = 3, 4
#: Characters of items in a broadcast index; beyond, items are joined by shuffle.
BLOCK_CHARACTERS = 2_000_000
#: Bits of the bitmap that selects shingles of the corpus, as a power of two: 16 MB.
BITMAP_BITS = 27

# The code points of Chinese characters.
HAN = "㐀-䶿一-鿿豈-﫿\U00020000-\U000323af"
WORD = re.compile(r"[^\W_]+")
#: A run of Chinese characters and digits; what is neither letter nor digit doesn't end it.
_CHINESE_RUN = re.compile(rf"[{HAN}\d](?:[\W_]*[{HAN}\d])*")
_HAN = re.compile(f"[{HAN}]")
_NOISE = re.compile(r"[\W_]+")


def word_tokens(text: str) -> list[list[str]]:
    """The words of a text, as one sequence."""
    return [WORD.findall(text.casefold())]


def chinese_tokens(text: str) -> list[list[str]]:
    """The runs of Chinese characters and digits of a text that are long enough for a window, by character."""
    if len(_HAN.findall(text)) == 0:
        return []
    runs = (_NOISE.sub("", run) for run in _CHINESE_RUN.findall(text.casefold()))
    return [list(run) for run in runs if len(run) >= CHARACTERS]


#: What stands between the texts of a batch; no text holds it (it is replaced there) and no item knows it.
_BREAK = "\x1e"
#: kind: (tokens of an item, window, shingle, tokens of a batch). In a batch a token that no item knows ends a run: in
#: Chinese text a word of another script is such a token.
KINDS = {
    "words": (word_tokens, WORDS, SHINGLE_WORDS, re.compile(rf"[^\W_]+|{_BREAK}")),
    "chinese": (chinese_tokens, CHARACTERS, SHINGLE_CHARACTERS, re.compile(rf"[{HAN}\d]|[^\W\d_{HAN}]+|{_BREAK}")),
}


class ItemIndex:
    """The windows of a block of items: token numbers, shingles, and from prefix shingles to windows."""

    def __init__(self, kind: str, items: list[tuple[int, str]]) -> None:
        tokens, self.window, self.width, _ = KINDS[kind]
        self.kind, self.vocabulary = kind, {}
        sequences = [(item, seq) for item, text in items if text for seq in tokens(text) if len(seq) >= self.window]
        for _, seq in sequences:
            for token in seq:
                self.vocabulary.setdefault(token, len(self.vocabulary))
        self.base = len(self.vocabulary) + 1
        windows, owners = [], []
        for item, seq in sequences:
            ids = np.array([self.vocabulary[t] for t in seq])
            view = np.lib.stride_tricks.sliding_window_view(ids, self.window)
            if kind == "chinese":  # a window of digits alone is no Chinese text
                han = np.array([bool(_HAN.match(t)) for t in seq])
                view = view[np.lib.stride_tricks.sliding_window_view(han, self.window).any(axis=1)]
            windows.append(view)
            owners += [item] * len(view)
        self.windows = np.concatenate(windows) if windows else np.zeros((0, self.window), dtype=np.int64)
        self.owners = np.array(owners, dtype=np.int64)
        self.keys = np.unique(self.shingles(self.windows.T).ravel()) if len(self.windows) else np.zeros(0, dtype=np.int64)

    def shingles(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the shingles that begin at each place of axis 0 (a token that no item has makes it negative)."""
        n = len(ids) - self.width + 1
        if n <= 0:
            return np.zeros((0, *ids.shape[1:]), dtype=np.int64)
        out = np.zeros((n, *ids.shape[1:]), dtype=np.int64)
        alien = np.zeros(out.shape, dtype=bool)
        for k in range(self.width):  # base ** 4 stays below 2 ** 63 for a block's vocabulary
            part = ids[k : k + n]
            out = out * self.base + part + 1
            alien |= part < 0
        out[alien] = -1
        return out

    def order(self, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle (``counts`` by self.keys; ties: the smallest) as its prefix."""
        if not len(self.windows):
            self.prefix = self.starts = self.by_prefix = self.offsets = np.zeros(0, dtype=np.int64)
            return
        marks = self.shingles(self.windows.T).T
        rank = np.empty(len(self.keys), dtype=np.int64)
        rank[np.lexsort((self.keys, counts))] = np.arange(len(self.keys))
        offset = rank[np.searchsorted(self.keys, marks)].argmin(axis=1)
        chosen = marks[np.arange(len(marks)), offset]
        self.by_prefix = np.argsort(chosen, kind="stable")
        self.prefix, self.starts = np.unique(chosen[self.by_prefix], return_index=True)
        self.starts = np.r_[self.starts, len(chosen)]
        self.offsets = offset

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all texts one after the other, and where each text ends (at a break)."""
        tokens = KINDS[self.kind][3].findall(_BREAK.join([*texts, ""]))
        known = self.vocabulary.get
        ids = np.fromiter((known(t, -1) for t in tokens), dtype=np.int64, count=len(tokens))
        unknown = np.flatnonzero(ids < 0)
        return ids, unknown[[tokens[i] == _BREAK for i in unknown.tolist()]] if len(unknown) else unknown

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts and the items with a window in them, each pair once."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.prefix) or not texts:
            return none, none
        ids, ends = self.numbers(texts)
        marks = self.shingles(ids)
        at = np.searchsorted(self.prefix, marks)
        at[at == len(self.prefix)] = 0
        hits = np.flatnonzero(self.prefix[at] == marks)
        counts = self.starts[at[hits] + 1] - self.starts[at[hits]]
        if not len(hits):
            return none, none
        # every window that begins with a hit's shingle at its place
        first = np.repeat(self.starts[at[hits]] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        group = self.by_prefix[first]
        begin = np.repeat(hits, counts) - self.offsets[group]
        fits = (begin >= 0) & (begin + self.window <= len(ids))  # bounds by position and length
        group, begin = group[fits], begin[fits]
        for k in range(self.window):  # verified token by token; a window that crosses a break fails at it
            if not len(group):
                break
            equal = ids[begin + k] == self.windows[group, k]
            group, begin = group[equal], begin[equal]
        pairs = np.unique(np.stack([np.searchsorted(ends, begin), self.owners[group]]), axis=1)
        return pairs[0], pairs[1]


def _texts(index: ItemIndex, texts: list[str]) -> list[int]:
    """Which texts can hold a window of an index at all."""
    if index.kind == "words":
        return list(range(len(texts)))
    return [k for k, t in enumerate(texts) if not t.isascii() and _HAN.search(t)]


def _slabs(column: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """The texts of a batch, folded, in groups of bounded size, and the row of each."""
    rows, texts, size = [], [], 0
    for row, own in enumerate(column.to_pylist()):
        for text in own or ():
            if text:
                rows.append(row)
                texts.append(text.casefold().replace(_BREAK, " "))
                size += len(text)
        if size > 500_000:
            yield rows, texts
            rows, texts, size = [], [], 0
    yield rows, texts


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = received(shared)
        totals = [np.zeros(len(i.keys), dtype=np.int64) for i in indexes]
        for batch in batches:
            for _, texts in _slabs(batch.column(1)):
                for index, total in zip(indexes, totals):
                    if len(index.keys) and (which := _texts(index, texts)):
                        marks = index.shingles(index.numbers([texts[k] for k in which])[0])
                        at = np.searchsorted(index.keys, marks)
                        at[at == len(index.keys)] = 0
                        total += np.bincount(at[index.keys[at] == marks], minlength=len(total))
        for k, total in enumerate(totals):
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), k), pa.int32()), pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["k", "shingle", "n"])

    return count


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = received(shared)
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for rows, texts in _slabs(batch.column(1)):
                found = set()
                for index in indexes:
                    which = _texts(index, texts)
                    number, items = index.found([texts[k] for k in which])
                    found |= {(int(i), int(ids[rows[which[n]]])) for n, i in zip(number, items)}
                pairs = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["item", "row"])

    return find


def _by_broadcast(texts: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """``item, row`` by an index of all items in every task."""
    spark = texts.sparkSession
    indexes = [ItemIndex(kind, items) for kind in KINDS]
    counts = [np.zeros(len(i.keys), dtype=np.int64) for i in indexes]
    shared = broadcast_object(spark, indexes)
    counted = texts.mapInArrow(_counter(shared), "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n"))
    for r in counted.toArrow().to_pylist():  # one row for each shingle of the items at most
        counts[r["k"]][r["shingle"]] = r["n"]
    for index, count in zip(indexes, counts):
        index.order(count)
    shared = broadcast_object(spark, indexes)
    return texts.mapInArrow(_finder(shared), "item long, row long")


class Shingler:
    """64-bit hashes of the shingles of a sequence of tokens; every word is hashed once."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, kind: str, tokens: list[str]) -> np.ndarray:
        width = KINDS[kind][2]
        if len(tokens) < width:
            return np.zeros(0, dtype=np.int64)
        if len(self.known) > 400_000:  # bounds the table
            self.known.clear()
        known = self.known
        for t in tokens:
            if t not in known:
                known[t] = xxhash.xxh64_intdigest(t)
        h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        n = len(h) - width + 1
        out = np.full(n, sum(map(ord, kind)), dtype=np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


_JOINT = "\x1f"  # between the tokens of a window


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ``item, turn`` the windows of each turn and the hashes of their shingles."""
    shingler = Shingler()
    for batch in batches:
        out = []
        for item, turn in zip(*(batch.column(k).to_pylist() for k in range(2))):
            for kind, (tokens, window, width, _) in KINDS.items():
                for seq in tokens(turn.replace(_BREAK, " ")):
                    marks = shingler(kind, seq).tolist()
                    han = [bool(_HAN.match(t)) for t in seq] if kind == "chinese" else None
                    for i in range(len(seq) - window + 1):
                        if han is None or any(han[i : i + window]):
                            out.append((item, _JOINT.join(seq[i : i + window]), marks[i : i + window - width + 1]))
        columns = list(zip(*out)) if out else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.int64())))], names=["item", "window", "shingles"])


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """The leading bits of all hashes of column ``shingle`` as a bitmap of 2 ** BITMAP_BITS bits, whatever their number."""
    place = F.shiftrightunsigned("shingle", 64 - BITMAP_BITS) + 1
    rows = shingles.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(max(1, (1 << BITMAP_BITS) // 8), dtype=np.uint8)
    for r in rows:
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        at = (r["bucket"] - 1) * len(part)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def _chosen(bitmap: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The places of hashes that the bitmap holds; a few more may pass, which the join drops."""
    at = marks.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return np.flatnonzero((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)


def _sequences(text: str) -> Iterator[tuple[str, list[str]]]:
    for kind, (tokens, *_) in KINDS.items():
        for seq in tokens(text):
            yield kind, seq


def _counter_by_hash(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, shingler = received(shared), Shingler()
        for batch in batches:
            for _, texts in _slabs(batch.column(1)):
                found = [marks[_chosen(bitmap, marks)] for text in texts for kind, seq in _sequences(text) if len(marks := shingler(kind, seq))]
                keys, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *found]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return count


def _finder_by_hash(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, shingler = received(shared), Shingler()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, texts in _slabs(batch.column(1)):
                out = []
                for row, text in zip(rows, texts):
                    for kind, seq in _sequences(text):
                        marks, window, width = shingler(kind, seq), KINDS[kind][1], KINDS[kind][2]
                        for i in _chosen(bitmap, marks).tolist():
                            a = max(0, i - (window - width))
                            out.append((int(marks[i]), ids[row], seq[a : i + window], i - a))
                columns = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32()))], names=["shingle", "row", "around", "before"])

    return find


def _by_shuffle(texts: DataFrame, turns: DataFrame) -> DataFrame:
    """``item, row`` by joins on hashed shingles; only bitmaps of a fixed size are broadcast."""
    spark = texts.sparkSession
    windows = staged(turns.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_item_windows, "item long, window string, shingles array<long>"))
    marked = staged(windows.select("window", "shingles").dropDuplicates(["window"]).select("window", F.posexplode("shingles").alias("offset", "shingle")))
    shared = broadcast_object(spark, _bitmap(marked))
    counts = texts.mapInArrow(_counter_by_hash(shared), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = marked.select("shingle").distinct().join(counts, "shingle", "left").select("shingle", F.coalesce("n", F.lit(0)).alias("n"))
    # the rarest shingle of each window; one that the corpus lacks rules the window out
    prefix = marked.join(counts, "shingle").groupBy("window").agg(F.min_by(F.struct("shingle", "offset", "n"), F.struct("n", "shingle")).alias("p"))
    prefix = staged(prefix.select("window", "p.*").where("n > 0"))
    shared = broadcast_object(spark, _bitmap(prefix))
    places = texts.mapInArrow(_finder_by_hash(shared), "shingle long, row long, around array<string>, before int")
    met = salted_join(places, prefix, ["shingle"], "n", F.col("row")).where(F.col("before") >= F.col("offset"))  # bound by position
    length = F.size(F.split("window", _JOINT))
    inside = F.array_join(F.slice("around", F.col("before") - F.col("offset") + 1, length), _JOINT)
    verified = met.where(inside == F.col("window")).select("window", "row").distinct()
    return verified.join(windows.select("window", "item").distinct(), "window").select("item", "row")


def leaked_items(items: DataFrame, corpus: DataFrame, item_id: str = "question_id", turns: str = "turns", row_id: str = "sample_id", messages: str = "messages") -> DataFrame:
    """``item_id, row_id`` of every item with a window in one message content of a corpus row.

    ``items[turns]`` is an array of texts, ``corpus[messages]`` an array of structs with a field ``content``.
    Letter case, punctuation and whitespace don't matter. NULL ids, texts and messages, and texts shorter than a
    window, match nothing; each pair of ids comes out once, however often its windows occur and its rows repeat;
    an empty table on either side gives no rows. Other columns are ignored. Any number of items is taken; a text is
    read whole.
    """
    texts = spread(corpus.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("row"), F.col(f"{messages}.content").alias("texts")))
    exploded = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.explode(turns).alias("turn")).where("turn IS NOT NULL")
    size = exploded.agg(F.sum(F.length("turn"))).first()[0] or 0
    found = _by_broadcast(texts, [(r["item"], r["turn"]) for r in exploded.toArrow().to_pylist()]) if size <= BLOCK_CHARACTERS else _by_shuffle(texts, exploded)
    return found.distinct().select(F.col("item").alias(item_id), F.col("row").alias(row_id))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The test questions that leaked into each contaminated chat."""
    return leaked_items(table(spark, root, "questions"), table(spark, root, "chats"))


# DuckDB's form: windows as lists of words, and as runs of Chinese characters and digits. RE2's classes are spelled out.
_SQL_WORDS = r"regexp_extract_all(lower(replace(replace(%s, 'ß', 'ss'), 'ẞ', 'ss')), '[\p{L}\p{N}]+')"
_SQL_HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
_SQL_RUNS = rf"regexp_extract_all(regexp_replace(lower(%s), '[^\p{{L}}\p{{N}}]+', '', 'g'), '[{_SQL_HAN}\p{{Nd}}]{{20,}}')"
SQL = {
    "p4_found": rf"""
WITH turn AS (SELECT question_id, unnest(turns) AS t FROM questions),
content AS (SELECT sample_id, m.content AS t FROM (SELECT sample_id, unnest(messages) AS m FROM chats)),
q AS (SELECT question_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT question_id, {_SQL_WORDS % 't'} AS w FROM turn) WHERE len(w) >= 12),
c AS (SELECT sample_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT sample_id, {_SQL_WORDS % 't'} AS w FROM content) WHERE len(w) >= 12),
qz AS (SELECT question_id, r, unnest(range(1, length(r) - 18)) AS i FROM (SELECT question_id, unnest({_SQL_RUNS % 't'}) AS r FROM turn)),
cz AS (SELECT sample_id, r, unnest(range(1, length(r) - 18)) AS i FROM (SELECT sample_id, unnest({_SQL_RUNS % 't'}) AS r FROM content))
SELECT question_id, sample_id FROM (SELECT DISTINCT question_id, array_to_string(w[i:i+11], ' ') AS x FROM q) JOIN (SELECT DISTINCT sample_id, array_to_string(w[i:i+11], ' ') AS x FROM c) USING (x)
UNION SELECT question_id, sample_id FROM (SELECT DISTINCT question_id, substr(r, i, 20) AS x FROM qz) JOIN (SELECT DISTINCT sample_id, substr(r, i, 20) AS x FROM cz) USING (x) WHERE regexp_matches(x, '[{_SQL_HAN}]')""",
}
