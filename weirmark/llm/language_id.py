"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of its
labelled text. A document is parsed with each automaton into the longest
phrases that occur in that language's text; the fewer phrases per letter, the
better the language describes it, and the fewest wins.

The transitions of all automata lie in one array: a state is a place in it, the
transition by letter class c stands c places further and names its owner, and
states are laid so that none overlap. So a language costs a few MB of a task
whatever its alphabet, and a step is one lookup. Documents walk the array in
step, each from its first letter to its last; the few that are longer than the
others are finished one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirmark.llm.common import materialise
from weirmark.llm.samples import remainder

#: The sample of each language: documents, and letters of all of them together.
SAMPLE_DOCS, SAMPLE_LETTERS = 96, 32_000
#: Candidates for the sample that are expected to meet in one task, as a multiple of it.
FOUND = 4
#: Documents that are parsed together, letters of each that are laid out at a time.
LANES, STRETCH = 1000, 256
#: Fewer documents than this are parsed one by one.
FEW = 24
UNKNOWN = "und"
OWNER, TARGET = 32, (1 << 32) - 1


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``text``; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


def laid_out(step: list[dict[int, int]]) -> tuple[np.ndarray, int]:
    """The transitions in one array, and the place of the root; -1 where there is none.

    States draw places, those with many transitions first, and draw again
    where they overlap with others.
    """
    many = np.fromiter(map(len, step), np.int64, len(step))
    letters = np.fromiter((c for out in step for c in out), np.int64, int(many.sum()))
    targets = np.fromiter((t for out in step for t in out.values()), np.int64, len(letters))
    begins = np.cumsum(many) - many
    size = 3 * len(letters) + (int(letters.max()) if len(letters) else 0) + 64
    rng = np.random.default_rng(5)
    places = np.full(len(step), size, np.int64)  # what owns nothing has one place together
    full, taken = np.zeros(2 * size, bool), np.zeros(size, bool)
    order = np.argsort(-many, kind="stable")
    order = order[many[order] > 0]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(many[order])) + 1, [len(order)]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        left = order[a:b]
        while len(left):
            m = int(many[left[0]])
            drawn = rng.integers(0, size, len(left))
            slots = drawn[:, None] + letters[begins[left][:, None] + np.arange(m)]
            good = ~full[slots].any(axis=1) & ~taken[drawn]
            left, drawn, slots, again = left[good], drawn[good], slots[good], left[~good]
            # Of states that draw the same place or slot, the first has it.
            first = np.zeros(len(left), bool)
            first[np.unique(drawn, return_index=True)[1]] = True
            claim = np.full(2 * size, len(left), np.int64)
            np.minimum.at(claim, slots.ravel(), np.repeat(np.arange(len(left)), m))
            first &= (claim[slots] == np.arange(len(left))[:, None]).all(axis=1)
            full[slots[first].ravel()] = True
            taken[drawn[first]] = True
            places[left[first]] = drawn[first]
            left = np.concatenate((left[~first], again))
    entries = np.full(2 * size, -1, np.int64)
    owner = np.repeat(places, many)
    entries[owner + letters] = owner << OWNER | places[targets]
    last = int(np.flatnonzero(entries >= 0).max(initial=0))
    return entries[: max(last, size) + 1], int(places[0])


def alphabet_of(texts: Iterable[str]) -> str:
    """All lower-case letters of the texts."""
    return "".join(sorted({c for t in texts for c in t.lower() if c.isalpha()}))


class Letters:
    """Classes of characters: 0 for what is no letter, 1 for letters not in the sample, then one per lower-case letter."""

    def __init__(self, alphabet: str):
        self.alphabet = alphabet
        place = {c: i + 2 for i, c in enumerate(self.alphabet)}
        self.table = np.zeros(0x110000, np.int32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                self.table[code] = place.get(c.lower(), 1)
        self.classes = len(place) + 2

    def of(self, text: str) -> np.ndarray:
        """Classes of the letters of ``text``, one 0 for each stretch between words."""
        found = self.table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        if len(found):
            found = found[(found > 0) | np.concatenate(([False], found[:-1] > 0))]
        return found


def automata(samples: dict[str, np.ndarray], classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The automata of all languages, by name, in one array; their roots; where a new phrase begins in each by its first letter."""
    parts, roots, begin, base = [np.zeros(0, np.int64)], [], [], 0
    for language in sorted(samples):
        own, root = laid_out(suffix_automaton(samples[language]))
        own = np.append(own, np.full(classes, -1))
        own = np.where(own >= 0, own + (base << OWNER) + base, -1)
        out = own[root : root + classes]
        begin.append(np.where(out >> OWNER == root + base, out & TARGET, root + base))
        parts.append(own)
        roots.append(root + base)
        base += len(own)
    return np.concatenate(parts), np.array(roots, np.int64), np.array(begin, np.int64).reshape(len(roots), classes)


class Parser:
    def __init__(self, letters: Letters, languages: list[str], entries: np.ndarray, roots: np.ndarray, begin: np.ndarray):
        self.letters, self.languages, self.entries, self.roots, self.begin = letters, languages, entries, roots, begin

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases that each whole text is parsed into."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        state = np.repeat(self.roots[:, None], len(texts), axis=1)
        counts = np.ones(state.shape, np.int64)
        at = 0
        while (n := int(np.searchsorted(-sizes, -at, side="left"))) >= FEW:  # documents longer than ``at``
            longest = min(at + STRETCH, int(sizes[0]))
            letters = np.zeros((longest - at, n), np.int32)
            for lane, i in enumerate(order[:n]):
                part = texts[i][at:longest]
                letters[: len(part), lane] = part
            for c, m in zip(letters, np.searchsorted(-sizes, -np.arange(at, longest), side="left").tolist(), strict=True):
                now, c = state[:, :m], c[:m]
                found = self.entries[now + c]
                new = found >> OWNER != now
                counts[:, :m] += new
                state[:, :m] = np.where(new, self.begin[:, c], found & TARGET)
            at = longest
        if n:
            entries = memoryview(self.entries)
            for k in range(len(self.languages)):
                begin = self.begin[k].tolist()
                for lane in range(n):
                    now, more = int(state[k, lane]), 0
                    for c in texts[order[lane]][at:].tolist():
                        found = entries[now + c]
                        if found >> OWNER == now:
                            now = found & TARGET
                        else:
                            now = begin[c]
                            more += 1
                    counts[k, lane] += more
        total = np.empty((len(texts), len(self.languages)), np.int64)
        total[order] = counts.T
        return total


def _predict(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parsers.get(key)
        if parser is None:
            _parsers.clear()
            alphabet, languages, arrays = shared.value
            parser = _parsers[key] = Parser(Letters(alphabet), languages, *arrays)
        for whole in batches:
            for s in range(0, whole.num_rows, LANES):
                batch = whole.slice(s, LANES)
                texts = [parser.letters.of(t.as_py()) for t in batch.column("text")]
                named = np.array([bool(t.any()) for t in texts])
                found, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if parser.languages and named.any():
                    n = parser.phrases(texts).astype(np.float64)
                    best = n.argmin(axis=1)  # the first of equals
                    # How far the others are from the fewest phrases.
                    with np.errstate(divide="ignore", invalid="ignore"):
                        share = 1 / ((n.min(axis=1)[:, None] / n) ** 8).sum(axis=1)
                    found[named], scores[named] = np.array(parser.languages, object)[best[named]], share[named]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.tolist(), pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return run


_parsers: dict[str, Parser] = {}


def language_samples(docs: DataFrame, held_out: tuple[int, int], id_col: str, text_col: str, lang_col: str, sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS) -> dict[str, str]:
    """Text of each language: pieces of ``sample_docs`` of its texts, ``sample_letters`` characters together.

    Texts are drawn by their hash, copies counting once and held-out rows
    never. Each gives a piece of the same size, at a place that its hash
    chooses; equal pieces count once.
    """
    parts, part = held_out
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", parts) != part))
    texts = known.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    languages = materialise(texts.groupBy("lang").count(), "languages")  # so Spark knows its size before it plans the join
    # Hashes are even, so those under this bound are about FOUND times the sample, however many texts there are.
    small = F.col("h") / F.lit(2.0**64) + 0.5 < F.lit(float(FOUND * sample_docs)) / F.col("count")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    drawn = texts.join(languages, "lang").where(small).withColumn("n", place).where(F.col("n") <= sample_docs)
    drawn = materialise(drawn.select("lang", "h", "doc_id", "n", F.count("*").over(Window.partitionBy("lang")).alias("of")), "sample")
    size = F.ceil(F.lit(sample_letters) / F.col("of")).cast("int")
    begin = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - size + 1, F.lit(1))).cast("int") + 1
    rows = known.withColumn("h", F.xxhash64("text")).join(drawn, ["lang", "h", "doc_id"]).select("lang", "n", F.substring("text", begin, size).alias("text")).dropDuplicates(["lang", "n"]).collect()
    joined: dict[str, dict[str, None]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["n"])):
        joined.setdefault(r["lang"], {})[r["text"]] = None
    return {k: " ".join(v) for k, v in joined.items()}


def identify_language(docs: DataFrame, held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    ``held_out`` is (parts, part): labels of rows whose crc32(id as text) has
    remainder ``part`` are never read. Every language that a row outside them
    is labelled with is learned, from a sample bounded by ``sample_docs`` and
    ``sample_letters``; a task holds a few MB for each. Texts are parsed whole,
    however long; a long one costs its letters. ``lang_pred`` is a language of the sample, the first by name if several need equally few phrases; ``und`` with
    score 0 for a null text, one without letters, or if nothing is labelled.
    ``score`` is near 1 when the others need far more phrases. A null id is
    held out; repeated rows are rows like others; an empty table gives an empty
    result; other columns are ignored.
    """
    parts, part = held_out
    samples = language_samples(docs, held_out, id_col, text_col, lang_col, sample_docs, sample_letters)
    letters = Letters(alphabet_of(samples.values()))
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    arrays = automata({k: letters.of(t) for k, t in samples.items()}, letters.classes)
    shared = docs.sparkSession.sparkContext.broadcast((letters.alphabet, sorted(samples), arrays))  # a few MB for each language
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInArrow(_predict(shared, key), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(remainder("doc_id", parts) == part, F.lit(True)).alias("held_out"), "lang_pred", "score")
