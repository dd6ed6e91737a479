"""Problem 2: the language of every text and of every passage in another language.

Method: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties, followed by temperature calibration.

The unit of decision is the sentence. A sentence's features are the character n-grams (1 to 3) of its words,
with word borders, hashed; a script without blanks gives its characters as words. Term frequency is relative to
the sentence, so the score is a sum over words divided by a count: each word's part is computed once per task and
looked up from then on, which makes scoring a dictionary lookup a word. Runs of sentences of one language make
the segments of a text; short or doubtful sentences follow their neighbours.

The classifier (weights, document frequencies, temperature) is fitted on the driver on a bounded sample of
labelled rows: about SAMPLE_ROWS rows for each label and table, about MAX_SAMPLE altogether. Everything else
reads every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.runtime import broadcast_object, received, spread, staged, table

#: Bound of the training sample: rows for each label and table, and rows altogether.
SAMPLE_ROWS, MAX_SAMPLE = 700, 25_000
#: Sentences for each label that training uses at most.
SAMPLE_SENTENCES = 2000
#: A label with a smaller share of the sample is no language to be learnt.
LEAST_LABELLED = 10
#: A text is judged if it has so many letters outside fences.
LEAST_LETTERS = 40
#: A sentence tells a language if it has so many letters (characters of a script without blanks) in so many words and this confidence.
SENTENCE_LETTERS, SENTENCE_WIDE, SENTENCE_WORDS, CONFIDENCE = 22, 8, 4, 0.6
#: A sentence counts as foreign in its text only if its probability of being in the text's main language is at most this.
DOUBT = 0.1

_BUCKETS = 1 << 17
_SCALE = 10.0
NO_LABEL = ("", "und")  # fixed values

# The blocks of scripts without blanks.
_WIDE = "぀-ヿ㐀-鿿"
_TOKEN = re.compile(rf"[{_WIDE}]|[^\W\d_{_WIDE}]+|\x1e|[.!?](?=\W|$)|[。！？]|\n(?=[ \t]*\n)")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_ENDS = frozenset(".!?。！？\n\x1e")


#: Lines that program code without a fence may have made; what of them is prose is kept, see ``_prose``.
_CODE = re.compile(r"(?m)^[ \t]*(?:def |class \w+.*:|return\b|import |print\(|(?:for|if|while|elif|with) .*:[ \t]*$|else:|[\w.\[\]]+ ?[-+*/|]?= |.*\w_\w+ ?[(=*+]|.*\w\(\w*_\w+).*$")
#: A name of program code, with what it is called with if that is single words.
_NAME = re.compile(r"(?a:\b(?:\w+\.)*\w*[^\W_]_+\w+|\bself(?:\.\w+)+)(?:\(\s*[^\s(),]*(?:,\s*[^\s(),]+)*\s*\))?")
_PIECE = re.compile(r".+?(?:[.!?](?=\s|$)|[。！？]|$)")
_MARK = re.compile(r"_|[\w\])][(\[]|[=<>{}]|\w\.\w")
_WORD = re.compile(r"[(\[\"'“”«»„¿¡—-]*[^\W\d_]+(?:['’-][^\W\d_]+)*[)\]\"'“”«»,;:.!?…—-]*")
_WIDE_LETTER = re.compile(f"[{_WIDE}]")


def outside_fences(text: str) -> str:
    """``text`` without what stands in ``` fences; an unclosed fence runs to the end."""
    return _FENCE.sub("\n\n", text) if "```" in text else text


def _letters(text: str) -> int:
    return sum(len(t) for t in _TOKEN.findall(text.lower()) if t not in _ENDS)


def _runs(words: list[str], worth: list[float]) -> list[str]:
    """The stretches worth at least SENTENCE_WORDS, in order: the best one and those on both sides of it."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for k, w in enumerate(worth):
        if total <= 0:
            total, start = 0.0, k
        total += w
        if total > best:
            best, begin, end = total, start, k + 1
    if best < SENTENCE_WORDS:
        return []
    return [*_runs(words[:begin], worth[:begin]), " ".join(words[begin:end]), *_runs(words[end:], worth[end:])]


def _prose_of_line(line: re.Match) -> str:
    out = []
    for piece in _PIECE.findall(line[0]):
        words = _NAME.sub(" ", piece).split()
        if not _MARK.search(piece) and (out or len(words) >= SENTENCE_WORDS or len(_WIDE_LETTER.findall(piece)) >= SENTENCE_WIDE):
            out.append(piece)
            continue
        worth = [wide / 2 if (wide := len(_WIDE_LETTER.findall(w))) else 1 if _WORD.fullmatch(w) else 0 if w.strip(",.;:").isdigit() else -2 for w in words]
        out += ["\n\n", *(run + "\n\n" for run in _runs(words, worth))]
    return "".join(out)


def _prose(text: str) -> str:
    """``text`` outside fences without program code that lost its fence.

    Names of code are taken out of their sentences. Of a line that looks like code, sentences free of its marks stay
    as they are, and of the others every stretch that is mostly words, at least SENTENCE_WORDS of them.
    """
    text = outside_fences(text)
    return _NAME.sub(" ", _CODE.sub(_prose_of_line, text)) if "_" in text or "self." in text else text


class Scorer:
    """A fitted classifier and its table of words."""

    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.languages, self.bias, self.temperature = languages, bias, temperature
        self.table = (weights * idf[:, None]).astype(np.float32)  # TF-IDF is linear in the count of an n-gram
        self.slot: dict[str, int] = {}
        self.vectors = np.zeros((1024, len(languages) + 3), dtype=np.float32)

    def learn(self, words: list[str]) -> None:
        """Add new words to the table: their summed scores, number of n-grams, letters, and if of a wide script."""
        keys, counts = ngrams(words)
        parts = np.add.reduceat(self.table[keys], np.r_[0, np.cumsum(counts)[:-1]], axis=0)
        size = len(self.slot)
        while size + len(words) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        new = self.vectors[size : size + len(words)]
        new[:, : len(self.languages)] = parts
        new[:, -3] = counts
        new[:, -2] = [len(w) for w in words]
        new[:, -1] = [len(w) == 1 and "぀" <= w <= "鿿" for w in words]
        for k, word in enumerate(words):
            self.slot[word] = size + k

    def sentences(self, text: str) -> tuple[np.ndarray, ...]:
        """Of every sentence: text number (by \\x1e), probabilities, letters, words, wide letters."""
        tokens = _TOKEN.findall(text.lower())
        if len(self.slot) > 400_000:  # bounds the table; names are without number
            self.slot.clear()
        slot = self.slot
        for t in _ENDS:
            slot.setdefault(t, -2 if t == "\x1e" else -1)
        ids = list(map(slot.get, tokens))
        if None in ids:
            unseen = list(dict.fromkeys(t for t, i in zip(tokens, ids) if i is None))
            ends = {t: slot.pop(t) for t in _ENDS}
            self.learn(unseen)
            slot.update(ends)
            ids = list(map(slot.get, tokens))
        ids = np.array(ids, dtype=np.int64)
        is_end = ids < 0
        owner, number = np.cumsum(ids == -2), np.cumsum(is_end)
        words = ~is_end
        number, owner, ids = number[words], owner[words], ids[words]
        rows = self.vectors[ids]
        if not len(rows):
            return np.zeros(0, dtype=np.int64), np.zeros((0, len(self.languages))), *(np.zeros(0),) * 3
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        summed = np.add.reduceat(rows, starts, axis=0)
        k = len(self.languages)
        logits = (summed[:, :k] / summed[:, k : k + 1] * _SCALE + self.bias) / self.temperature
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        changes = np.r_[True, (ids[1:] != ids[:-1]) | (number[1:] != number[:-1])]  # a word again and again is one
        return owner[starts], p, summed[:, -2], np.add.reduceat(changes.astype(np.int64), starts), summed[:, -1]


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all words in one array, and how many each word has."""
    text = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), np.diff(np.r_[0, ends]))
    keys, owners = [], []
    for n in (1, 2, 3):
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(h)]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        same = word[: len(h)] == word[n - 1 :]
        if n == 1:
            same &= c > 3
        keys.append((h[same] & np.uint64(_BUCKETS - 1)).astype(np.int64))
        owners.append(word[: len(h)][same])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(keys)[order], np.bincount(owner, minlength=len(words))


class FollowTheRegularisedLeader:
    """Multinomial logistic regression, per-coordinate FTRL-proximal with L1 and L2 penalties, by mini-batches."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n, self.w = (np.zeros((_BUCKETS, classes)) for _ in range(3))
        self.bz, self.bn, self.b = (np.zeros(classes) for _ in range(3))

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([x @ self.w[k] + self.b for k, x in rows])

    def _step(self, z, n, w, g, l1):
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        z = z + g - sigma * w
        n = n + g * g
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))
        return z, n, w

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int, epochs: int = 3, batch: int = 256) -> None:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                keys = np.concatenate([rows[i][0] for i in chosen])
                values = np.concatenate([rows[i][1] for i in chosen])
                lengths = np.array([len(rows[i][0]) for i in chosen])
                owner = np.repeat(np.arange(len(chosen)), lengths)
                logits = np.add.reduceat(self.w[keys] * values[:, None], np.r_[0, np.cumsum(lengths)[:-1]], axis=0) + self.b
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(chosen)), labels[chosen]] -= 1
                touched, place = np.unique(keys, return_inverse=True)
                g = np.stack([np.bincount(place, weights=values * p[owner, k]) for k in range(p.shape[1])], axis=1) / len(chosen)
                self.z[touched], self.n[touched], self.w[touched] = self._step(self.z[touched], self.n[touched], self.w[touched], g, self.l1)
                self.bz, self.bn, self.b = self._step(self.bz, self.bn, self.b, p.mean(axis=0), 0.0)


def _split(text: str) -> list[list[str]]:
    """The words of each sentence."""
    out, now = [], []
    for token in _TOKEN.findall(_prose(text).lower()):
        if token in _ENDS:
            out.append(now)
            now = []
        else:
            now.append(token)
    out.append(now)
    return [s for s in out if len(s) >= 4]


def _varied(sentences: list[list[str]], rng: np.random.Generator) -> list[list[str]]:
    """At most SAMPLE_SENTENCES of them: half at random, half those with most words that are seldom but no hapax."""
    order = [sentences[i] for i in rng.permutation(len(sentences))]
    if len(order) <= SAMPLE_SENTENCES:
        return order
    half = SAMPLE_SENTENCES // 2
    counts: dict[str, int] = {}
    for sentence in order:
        for word in set(sentence):
            counts[word] = counts.get(word, 0) + 1
    limit = max(4, len(order) // 100)
    seldom = [sum(3 <= counts[w] <= limit for w in s) / len(s) for s in order[half:]]
    return order[:half] + [order[half + i] for i in np.argsort(seldom, kind="stable")[::-1][:half]]


def _rows(sentences: list[list[str]], rng: np.random.Generator, parts: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams and relative frequencies of sentences and, with ``parts``, of five words of each longer one."""
    words = list(dict.fromkeys(w for sentence in sentences for w in sentence))
    if not words:
        return []
    all_keys, counts = ngrams(words)
    ends = np.cumsum(counts)
    of = dict(zip(words, np.split(all_keys, ends[:-1])))
    out = []
    for sentence in sentences:
        pieces = [sentence]
        if parts and len(sentence) > 7:  # short sentences must be told apart as well
            at = int(rng.integers(0, len(sentence) - 5))
            pieces.append(sentence[at : at + 5])
        for piece in pieces:
            keys, count = np.unique(np.concatenate([of[w] for w in piece]), return_counts=True)
            out.append((keys, count / count.sum() * _SCALE))
    return out


def _train(by_label: list[list[list[str]]], rng: np.random.Generator, seed: int, epochs: int) -> tuple[FollowTheRegularisedLeader, np.ndarray, float]:
    """A model, document frequencies and the temperature that a fifth of the rows, held out, calls for."""
    raw, labels = [], []
    for k, sentences in enumerate(by_label):
        own = _rows(sentences, rng, parts=True)
        raw += own
        labels += [k] * len(own)
    labels = np.array(labels)
    seen = np.zeros(_BUCKETS)
    for keys, _ in raw:
        seen[keys] += 1
    idf = np.log((1 + len(raw)) / (1 + seen)) + 1
    rows = [(k, v * idf[k]) for k, v in raw]
    order = rng.permutation(len(rows))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    model = FollowTheRegularisedLeader(len(by_label))
    model.fit([rows[i] for i in train], labels[train], seed, epochs)
    temperature, least = 1.0, np.inf
    if len(held):
        logits = model.logits([rows[i] for i in held])
        for t in np.geomspace(0.05, 5, 60):
            top = logits.max(axis=1, keepdims=True) / t
            loss = np.mean(np.log(np.exp(logits / t - top).sum(axis=1)) + top[:, 0] - logits[np.arange(len(held)), labels[held]] / t)
            if loss < least:
                least, temperature = loss, float(t)
    return model, idf, temperature


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Scorer:
    """A classifier from (text, label) rows; labels may be wrong here and there and texts mix languages.

    A first model is trained on sentences taken at random. Rows that it holds for mislabelled as a whole, and
    foreign sentences in the others, are dropped; the final model is trained on a varied choice of the rest.
    """
    by_row: dict[str, list[list[list[str]]]] = {}
    for text, label in samples:
        if sentences := _split(text):
            by_row.setdefault(label, []).append(sentences)
    languages = sorted(k for k, v in by_row.items() if sum(map(len, v)) >= LEAST_LABELLED)
    if not languages:
        return Scorer(["und"], np.zeros((_BUCKETS, 1)), np.zeros(_BUCKETS), np.zeros(1), 1.0)
    rng = np.random.default_rng(seed)
    flat = [[s for row in by_row[k] for s in row] for k in languages]
    first, idf, temperature = _train([[v[i] for i in rng.permutation(len(v))[: SAMPLE_SENTENCES // 2]] for v in flat], rng, seed, 2)
    rough = Scorer(languages, first.w, idf, first.b, temperature)
    cleaned = []
    for k, language in enumerate(languages):
        rows = by_row[language]
        joined = "\x1e".join(". ".join(" ".join(s) for s in row) for row in rows)
        owner, p, letters, _, _ = rough.sentences(joined)
        best, sure = p.argmax(axis=1), p.max(axis=1)
        own = np.bincount(owner, weights=letters * (best == k), minlength=len(rows))
        rest = np.bincount(owner, weights=letters * (best != k), minlength=len(rows))
        kept, at = [], np.searchsorted(owner, np.arange(len(rows) + 1))
        for r, row in enumerate(rows):
            if own[r] <= rest[r]:
                continue
            fits = (best[at[r] : at[r + 1]] == k) | (sure[at[r] : at[r + 1]] < 0.9)
            kept += [s for s, f in zip(row, fits) if f] if len(fits) == len(row) else []
        cleaned.append(_varied(kept, rng) or flat[k][:SAMPLE_SENTENCES])
    model, idf, temperature = _train(cleaned, rng, seed, 3)
    return Scorer(languages, model.w, idf, model.b, temperature)


def label_of(column: str) -> F.Column:
    """A row's label in lower case; NULL, blank and 'und' are no label."""
    folded = F.lower(F.trim(F.col(column)))
    return F.when(~folded.isin(*NO_LABEL), folded)


def training_sample(*sources: tuple[DataFrame, str, str, F.Column]) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts of ``(table, id column, label column, array of texts)``.

    About SAMPLE_ROWS rows of each label and table, the ids with the least hashes, so the sample doesn't depend on the
    order or layout of the rows. With so many labels that this would exceed MAX_SAMPLE, every label gives less in
    proportion. The counts of the labels stay in a table; rows whose id is NULL are not taken.
    """
    out = []
    for df, id_column, label, texts in sources:
        named = df.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), label_of(label).alias("label"), texts.alias("texts")).where("label IS NOT NULL")
        counts = staged(named.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
        wanted = counts.agg(F.sum(F.least("n", F.lit(SAMPLE_ROWS)))).first()[0] or 0
        share = min(1.0, MAX_SAMPLE / len(sources) / wanted) if wanted else 0.0
        chance = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 1_000_000
        chosen = named.join(counts, "label").where(chance * F.col("n") < F.least("n", F.lit(SAMPLE_ROWS)) * share)
        rows = chosen.select("label", "id", F.array_join("texts", "\n").alias("text")).collect()
        out += [(r["text"] or "", r["label"]) for r in sorted(rows, key=lambda r: (r["label"], r["id"], r["text"] or ""))]
    return out


_SEGMENT = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("first_sentence", pa.int32()), ("sentences", pa.int32()), ("letters", pa.int32()), ("full", pa.bool_())])


def segments(scorer: Scorer, texts: list[str], judged: list[bool] | None = None) -> list[list[tuple] | None]:
    """For each text its segments, or None where it has too few letters to be judged.

    ``judged`` names the texts that had enough letters before code was taken out: of these a full sentence is enough.
    A segment: language, confidence, first sentence, number of sentences, letters, whether its language is told by
    one of its sentences, or by most letters of a text of short sentences.
    """
    owner, p, letters, words, wide = scorer.sentences("\x1e".join(t.replace("\x1e", " ") for t in texts))
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    best, sure = p.argmax(axis=1), p.max(axis=1)
    # a sentence in another language than most of its text must rule that one out
    mass = np.zeros((len(texts), p.shape[1]))
    np.add.at(mass, owner, p * letters[:, None])
    main = mass.argmax(axis=1)[owner]
    alien = p[np.arange(len(p)), main] <= DOUBT
    full = np.where(best == main, sure >= CONFIDENCE, (sure >= CONFIDENCE) & alien) & np.where(2 * wide > letters, wide >= SENTENCE_WIDE, (letters >= SENTENCE_LETTERS) & (words >= SENTENCE_WORDS))
    best, sure, letters, full = best.tolist(), sure.tolist(), letters.tolist(), full.tolist()
    names = scorer.languages
    out: list[list[tuple] | None] = []
    for k in range(len(texts)):
        a, b = bounds[k], bounds[k + 1]
        telling = [i for i in range(a, b) if full[i]]
        if sum(letters[a:b]) < LEAST_LETTERS and not (judged and judged[k] and telling):
            out.append(None)
            continue
        if not telling:  # no sentence tells: all of them together, by letters
            votes: dict[int, float] = {}
            for i in range(a, b):
                votes[best[i]] = votes.get(best[i], 0.0) + sure[i] * letters[i]
            top = max(votes, key=votes.get)
            out.append([(names[top], votes[top] / max(sum(votes.values()), 1e-9), 0, int(b - a), int(sum(letters[a:b])), votes[top] >= CONFIDENCE * sum(votes.values()))])
            continue
        found: list[list] = []
        for i in range(a, b):
            language = best[i] if full[i] else (found[-1][0] if found else best[telling[0]])
            if not found or found[-1][0] != language:
                found.append([language, 0.0, i - a, 0, 0.0])
            at = found[-1]
            at[3] += 1
            at[4] += letters[i]
            at[1] += (sure[i] if best[i] == language else 1 - sure[i]) * letters[i]
        out.append([(names[x[0]], x[1] / max(x[4], 1), int(x[2]), x[3], int(x[4]), True) for x in found])
    return out


def _detector(shared):
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = received(shared)
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            row, pos, texts, size = [], [], [], 0
            lists = batch.column(2).to_pylist()
            last = len(lists) - 1
            for r, unit in enumerate(lists):
                for p, text in enumerate(unit or ()):
                    if text and len(text) >= LEAST_LETTERS:
                        row.append(r)
                        pos.append(p)
                        texts.append(text)
                        size += len(text)
                if size > 500_000 or r == last:  # bounds the working memory
                    if texts:
                        outside = [outside_fences(t) for t in texts]
                        prose = [_prose(t) for t in texts]
                        judged = [x != t and _letters(t) >= LEAST_LETTERS for x, t in zip(prose, outside)]
                        found = segments(scorer, prose, judged)
                        if bare := [k for k, f in enumerate(found) if f is None and judged[k]]:  # code alone: its best guess, no full sentence
                            for k, f in zip(bare, segments(scorer, [outside[k] for k in bare])):
                                found[k] = [(*s[:5], False) for s in f]
                        kept = [k for k, f in enumerate(found) if f is not None]
                        at = pa.array([row[k] for k in kept], pa.int64())
                        made = pa.array([[dict(zip(("lang", "confidence", "first_sentence", "sentences", "letters", "full"), s)) for s in found[k]] for k in kept], pa.list_(_SEGMENT))
                        yield pa.RecordBatch.from_arrays([ids.take(at), labels.take(at), pa.array([pos[k] for k in kept], pa.int32()), made], names=["rec_id", "label", "pos", "segments"])
                    row, pos, texts, size = [], [], [], 0

    return detect


def languages(scorer: Scorer, df: DataFrame, id_column: str, label: str, texts: F.Column) -> DataFrame:
    """``rec_id, label, pos, segments`` of every text with at least 40 letters outside ``` fences.

    ``texts`` is an array of texts; ``pos`` is a text's 0-based place in it; ``segments`` are its runs of
    sentences in one language, each with ``lang, confidence, first_sentence, sentences, letters`` and ``full``
    (false if nothing in the text tells its language with confidence). NULL lists, NULL and short texts give no rows;
    repeated rows come out again; an empty table gives no rows; other columns are ignored. Ties between
    languages go to the first by name.
    """
    source = df.select(F.col(id_column).cast("string").alias("rec_id"), label_of(label).alias("label"), texts.alias("texts"))
    schema = "rec_id string, label string, pos int, segments array<struct<lang string, confidence double, first_sentence int, sentences int, letters int, full boolean>>"
    return spread(source).mapInArrow(_detector(broadcast_object(df.sparkSession, scorer)), schema)


def _sources(spark: SparkSession, root: str) -> list[tuple[str, DataFrame, str, F.Column]]:
    chats, questions, documents = (table(spark, root, t) for t in ("chats", "questions", "documents"))
    return [
        ("chats", chats, "sample_id", F.col("messages.content")),
        ("questions", questions, "question_id", F.col("turns")),
        ("documents", documents, "doc_id", F.array("text")),
    ]


def fitted(spark: SparkSession, root: str) -> Scorer:
    """The classifier of a set of tables; give it to ``p2_found`` and ``p2_segments`` to fit it once for both."""
    return fit(training_sample(*((df, key, "lang", texts) for _, df, key, texts in _sources(spark, root))))


def _all_units(spark: SparkSession, root: str, scorer: Scorer | None) -> DataFrame:
    scorer = scorer or fitted(spark, root)
    parts = [languages(scorer, df, key, "lang", texts).select(F.lit(tab).alias("tab"), "*") for tab, df, key, texts in _sources(spark, root)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p2_segments(spark: SparkSession, root: str, scorer: Scorer | None = None) -> DataFrame:
    """Every message content, question turn and document, by passage, with language and confidence."""
    units = _all_units(spark, root, scorer)
    return units.select("tab", "rec_id", "pos", F.posexplode("segments").alias("segment", "s")).select("tab", "rec_id", "pos", "segment", "s.*")


def p2_found(spark: SparkSession, root: str, scorer: Scorer | None = None) -> DataFrame:
    """The languages of every text whose set of languages isn't exactly its row's label."""
    found = F.array_distinct(F.transform(F.filter("segments", lambda s: s["full"]), lambda s: s["lang"]))
    units = _all_units(spark, root, scorer).select("tab", "rec_id", "pos", "label", found.alias("langs"))
    wrong = units.where(F.col("label").isNull() | (F.size("langs") != 1) | (F.element_at("langs", 1) != F.col("label")))
    return wrong.select("tab", "rec_id", "pos", F.explode("langs").alias("lang"))
