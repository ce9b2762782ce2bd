"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds sample text. A document is parsed against it: each phrase is the longest match
from where the last one ended; few phrases mean that the text resembles the language. A phrase is coded as a place in the sample
and a letter, so it costs log(length of the sample x letters of the alphabet): longer samples have longer matches by that much. The
language with the least cost per symbol, the cross-parsing entropy, wins, whatever the sizes of the samples.

All documents of a batch are parsed in step, as lanes of ``SEGMENT`` symbols. A lane first assumes that a phrase begins at
its head. Then the phrase that is really open there is followed into the lane until one begins where the lane has one as
well; from there on both agree. So the counts are those of the whole text, whatever the lanes.

Defined cases: a null text or one without a letter is ``und`` with score 0, as is every document when nothing was learned.
Ties go to the language first in order of names. The score is 1 - (cost of the winner / cost of the runner-up), and 1
for a sole language. Symbols are lower-cased letters; each run of other characters counts as one break; a letter beyond the
``ALPHABET`` most frequent ones of the sample is three symbols of seven bits, so that no two letters are alike. Repeated
rows are returned as often as they occur; other columns are left out.

Learning reads a bounded sample, chosen by a hash of the text: at most ``docs_per_lang`` different texts by language, of each
twice its share of ``symbols_per_lang`` in characters (and ``doc_chars`` at most), which Spark cuts, and the ``max_languages`` most frequent languages.
The symbols are dealt to the texts evenly; what short ones leave goes to the longer ones. Predictions read whole texts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT = 512
UNKNOWN = "und"
#: Symbols: 0 is a break, then 128 for seven bits of a rare letter, then the frequent letters.
_BREAK, _BITS, _FIRST, _RARE = 0, 1, 129, 255
ALPHABET = _RARE - _FIRST


@dataclass
class Automaton:
    """Transitions of a suffix automaton, packed: that of a state by a symbol is at ``base[state] + symbol`` if ``owner`` is the state there.

    State 0 is the start. ``root`` is where a phrase that begins with a symbol goes; the last state has no way out.
    """

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    root: np.ndarray

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind one more symbol, and where it began a new phrase."""
        at = self.base.take(state)
        at += symbol
        missed = np.flatnonzero(self.owner.take(at) != state)
        out = self.to.take(at)
        out[missed] = self.root.take(symbol[missed])
        return out, missed


@dataclass
class Model:
    languages: list[str]
    alphabet: str
    automata: list[Automaton]
    lengths: list[int] = field(default_factory=list)  # symbols of each sample

    def costs(self) -> np.ndarray:
        """What a phrase costs by language: a place in its sample, and a letter, since one that is not in the sample is a phrase as well."""
        return np.log(np.maximum(self.lengths, 2) * float(len(self.alphabet) + 1))

    def __post_init__(self) -> None:
        self.code = np.full(0x110000, _RARE, np.uint8)
        for c in range(0x110000):
            if not chr(c).isalpha():
                self.code[c] = _BREAK
        for i, c in enumerate(self.alphabet):
            self.code[ord(c)] = _FIRST + i


def symbols(text: str, model: Model) -> np.ndarray:
    """Codes of a text, runs of breaks as one."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = model.code[points]
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == _BREAK) & (code[:-1] == _BREAK)
    code = code[~again]
    rare = code == _RARE
    if not rare.any():
        return code
    points = points[~again]
    size = np.where(rare, 3, 1)
    out = np.repeat(code, size)
    at = (np.cumsum(size) - size)[rare]
    for k, shift in enumerate((14, 7, 0)):
        out[at + k] = ((points[rare] >> np.uint32(shift)) & np.uint32(127)) + _BITS
    return out


def suffix_automaton(code: np.ndarray) -> list[dict[int, int]]:
    """Transitions by state of the suffix automaton of a sequence; state 0 is the start."""
    to: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in code.tolist():
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return to


def pack(states: list[dict[int, int]]) -> Automaton:
    """Rows of transitions laid into each other's gaps, the longest first; rows of one fill what is left."""
    n, total = len(states), sum(map(len, states))
    size = 2 * total + 1024
    base, owner, to = np.zeros(n + 1, np.int32), np.full(size + 512, -1, np.int32), np.zeros(size + 512, np.int32)
    free = np.ones(size + 512, bool)
    first = 256  # no base is negative
    hint = dict.fromkeys(range(257), first)
    for state in sorted(range(n), key=lambda s: -len(states[s])):
        row = states[state]
        if len(row) < 2:
            break
        keys = np.fromiter(row, np.int64, len(row))
        at = hint[len(row)]
        while True:
            if at + 1280 > len(free):
                grown = len(free)
                free = np.concatenate([free, np.ones(grown, bool)])
                owner, to = np.concatenate([owner, np.full(grown, -1, np.int32)]), np.concatenate([to, np.zeros(grown, np.int32)])
            fits = np.flatnonzero(free[at + np.arange(1024)[:, None] + keys].all(axis=1))
            if len(fits):
                break
            at += 1024
            hint[len(row)] = at
        place = at + int(fits[0])
        base[state] = place
        free[place + keys] = False
        owner[place + keys] = state
        to[place + keys] = np.fromiter(row.values(), np.int64, len(row))
    single = [s for s in range(n) if len(states[s]) == 1]
    slots = np.flatnonzero(free[first:])[: len(single)] + first
    if len(slots) < len(single):
        more = len(single) - len(slots)
        slots = np.concatenate([slots, np.arange(len(free), len(free) + more)])
        owner, to = np.concatenate([owner, np.full(more, -1, np.int32)]), np.concatenate([to, np.zeros(more, np.int32)])
    symbol = np.array([next(iter(states[s])) for s in single], np.int64)
    base[single] = slots - symbol
    owner[slots] = single
    to[slots] = [next(iter(states[s].values())) for s in single]
    top = int(np.flatnonzero(owner >= 0).max(initial=0)) + 1
    width = int(base.max()) + 257
    fit = lambda a, fill: np.concatenate([a[:top], np.full(max(0, width - top), fill, np.int32)])
    root = np.full(256, n, np.int32)
    root[list(states[0])] = list(states[0].values())
    return Automaton(base, fit(owner, -1), fit(to, 0), root)


def lane_phrases(automaton: Automaton, lanes: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Phrases that begin in each lane. lanes: steps x lanes, the longest first; before: the lane that each continues, or -1."""
    steps, n = lanes.shape
    begins, own = np.zeros((steps, n), bool), np.zeros(n, np.int32)
    begins[0] = lengths > 0
    live = np.searchsorted(-lengths, -np.arange(steps), "left")
    for s in range(steps):
        m = live[s]
        if not m:
            break
        own[:m], missed = automaton.step(own[:m], lanes[s, :m])
        begins[s, missed] = True
    left = np.cumsum(begins[::-1], axis=0, dtype=np.int32)[::-1]  # from each step on
    counts, end = left[0].astype(np.int64), own.copy()
    todo = np.flatnonzero(before >= 0)
    after = np.full(n, -1)
    after[before[todo]] = todo
    while len(todo):
        state, made = end[before[todo]], np.zeros(len(todo), np.int64)
        going = np.arange(len(todo))  # lanes whose open phrase does not yet agree
        last = own[todo]
        for s in range(steps):
            done = going[lengths[todo[going]] <= s]
            if len(done):
                counts[todo[done]], last[done] = made[done], state[done]
                going = going[lengths[todo[going]] > s]
            if not len(going):
                break
            lane = todo[going]
            state[going], missed = automaton.step(state[going], lanes[s, lane])
            if len(missed):
                met = begins[s, lane[missed]]
                made[going[missed]] += ~met
                agreed = missed[met]
                counts[lane[agreed]] = made[going[agreed]] + left[s, lane[agreed]]
                going = np.delete(going, agreed)
        counts[todo[going]], last[going] = made[going], state[going]
        changed = todo[last != end[todo]]
        end[todo] = last
        todo = after[changed]
        todo = todo[todo >= 0]
    return counts


def cross_parse(texts: list[str], model: Model, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by language and text, and the symbols of each text."""
    coded = [symbols(t, model) for t in texts]
    sizes = np.array([len(c) for c in coded], np.int64)
    pieces = -(-sizes // segment)
    owner = np.repeat(np.arange(len(texts)), pieces)
    number = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
    lengths = np.minimum(sizes[owner] - number * segment, segment)
    grid = np.zeros((len(owner), segment), np.uint8)
    at = 0
    for c, k in zip(coded, pieces.tolist(), strict=True):
        grid[at : at + k].reshape(-1)[: len(c)] = c
        at += k
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    before = np.where(number[order] > 0, place[np.maximum(order - 1, 0)], -1) if len(order) else order
    lanes = np.ascontiguousarray(grid[order].T)
    out = [np.bincount(owner[order], weights=lane_phrases(a, lanes, lengths[order], before), minlength=len(texts)) for a in model.automata]
    return np.stack(out), sizes


def predict(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """Language and score of each text, in parts of about a million characters."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    part: list[int] = []

    def flush() -> None:
        if part:
            counts, _ = cross_parse([texts[i] for i in part], model)
            for i, row in zip(part, (counts * model.costs()[:, None]).T, strict=True):
                best, *rest = np.argsort(row, kind="stable")
                out[i] = (model.languages[best], float(1 - row[best] / row[rest[0]]) if rest else 1.0)
            part.clear()

    chars = 0
    for i, t in enumerate(texts):
        if not t or not model.languages or not any(map(str.isalpha, t[:100])) and not any(map(str.isalpha, t)):
            continue
        part.append(i)
        chars += len(t)
        if chars >= 1_000_000:
            flush()
            chars = 0
    flush()
    return out


def sample(docs: DataFrame, docs_per_lang: int, symbols_per_lang: int, doc_chars: int, max_languages: int, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Up to ``docs_per_lang`` different text heads by language, in order of a hash of the text, which does not depend on ids or partitions."""
    place = F.xxhash64("text")
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    texts = known.groupBy("lang").agg(F.approx_count_distinct(place).alias("n"), F.count("*").alias("rows"))  # copies may be most of the rows
    sizes = {lang: n for lang, n, _ in texts.orderBy(F.desc("rows"), "lang").limit(max_languages).collect()}
    if not sizes:
        return {}
    share = F.lit(False)
    for lang, n in sizes.items():  # a hash threshold keeps about four times what is needed
        top = (1 << 63) - 1 if n <= 4 * docs_per_lang else int(2.0**64 * 4 * docs_per_lang / n - 2.0**63)
        share |= (F.col("lang") == lang) & (place <= F.lit(top).cast("long"))
    length = F.lit(doc_chars)
    for lang, n in sizes.items():
        length = F.when(F.col("lang") == lang, min(doc_chars, 2 * -(-symbols_per_lang // max(1, min(n, docs_per_lang))))).otherwise(length)
    heads = known.filter(share).select("lang", place.alias("place"), F.substring("text", F.lit(1), length).alias("text"))
    rows = heads.groupBy("lang", "place").agg(F.min("text").alias("text")).toLocalIterator()  # copies of a text count once
    by_lang = defaultdict(dict)
    for lang, h, text in rows:
        held = by_lang[lang]
        held[h] = text
        if len(held) > 2 * docs_per_lang:
            by_lang[lang] = dict(sorted(held.items())[:docs_per_lang])
    return {lang: [t for _, t in sorted(held.items())[:docs_per_lang]] for lang, held in sorted(by_lang.items())}


def even_parts(lengths: list[int], total: int) -> list[int]:
    """How much of each text is taken, ``total`` at most: the same of all that are long enough."""
    out = [0] * len(lengths)
    for left, i in zip(range(len(lengths), 0, -1), sorted(range(len(lengths)), key=lambda i: lengths[i]), strict=True):
        out[i] = min(lengths[i], total // left)
        total -= out[i]
    return out


def build(texts: dict[str, list[str]], symbols_per_lang: int, max_alphabet: int = ALPHABET) -> Model:
    """The automata of sample texts by language. Each language has the same say in what letters are frequent."""
    letters = Counter()
    for ts in texts.values():
        own = Counter()
        for t in ts:
            own.update(c for c in t.lower() if c.isalpha())
        total = sum(own.values())
        for c, n in own.items():
            letters[c] += n / total
    alphabet = "".join(sorted(c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:max_alphabet]))
    model = Model([], alphabet, [])
    for lang, ts in texts.items():
        codes = [symbols(t + " ", model) for t in ts]
        code = np.concatenate([c[:n] for c, n in zip(codes, even_parts(list(map(len, codes)), symbols_per_lang), strict=True)] or [np.zeros(0, np.uint8)])
        code = code[np.append(True, (code[1:] != _BREAK) | (code[:-1] != _BREAK))[: len(code)]]  # a break between texts counts once
        if (code != _BREAK).any():
            model.languages.append(lang)
            model.automata.append(pack(suffix_automaton(code)))
            model.lengths.append(len(code))
    return model


def fit(
    docs: DataFrame, docs_per_lang: int = 200, symbols_per_lang: int = 30_000, doc_chars: int = 20_000, max_languages: int = 200, text_col: str = "text", lang_col: str = "lang"
) -> Model:
    """Learn from labelled documents; see the module for what bounds the sample."""
    return build(sample(docs, docs_per_lang, symbols_per_lang, doc_chars, max_languages, text_col, lang_col), symbols_per_lang)


def language(docs: DataFrame, model: Model, text: Column) -> Column:
    """Struct lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict(list(texts), held.value), columns=["lang_pred", "score"])

    return guess(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, lang_pred, score."""
    return docs.select(F.col(id_col), language(docs, model, F.col(text_col)).alias("_l")).select(id_col, "_l.*")
