"""Languages of documents and of the segments of mixed ones, with a confidence.

A sentence is judged in two levels: first its family (Germanic or Romance by one linear support vector machine, Japanese by its
script), then, within the family, one-versus-one linear support vector machines between the closely related languages vote.
Features are hashed runs of two to four characters. The machines are fitted on a bounded sample of labelled documents
(``sample`` per label, picked by a hash of the id); sentences whose label contradicts the
frequencies of the whole sample are left out. Everything else runs over all rows and whole texts.

A language belongs to a text if at least one full sentence is in it. A sentence too short to tell, or without clear winner,
goes with the language of its neighbours. Null, empty and blank texts have no language. Texts without any letter, or in
a script of none of the languages, have none either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAMILIES = {"germanic": ("en", "de", "nl", "sv"), "romance": ("fr", "es", "pt", "it")}
LATIN = tuple(x for langs in FAMILIES.values() for x in langs)
PAIRS = tuple((a, b) for langs in FAMILIES.values() for i, a in enumerate(langs) for b in langs[i + 1 :])
# Other notations of the languages.
NOTATIONS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais", "es": "es spa spanish español espanol castellano",
    "pt": "pt por portuguese português portugues", "it": "it ita italian italiano", "nl": "nl nld dut dutch nederlands", "sv": "sv swe swedish svenska", "ja": "ja jpn japanese 日本語",
}
BUCKETS = 8192
#: Labelled documents per language for the fit, and sentences per document, on average, that the machines take.
SAMPLE, SENTENCES = 250, 3
#: A sentence counts for a language of its own from so many letters and this confidence on.
LETTERS, CERTAIN = 18, 0.9
# Begins with a character class: the matcher skips to the few places where a sentence can end.
_SPLIT = re.compile(r"[.!?…\n。！？](?:(?<=\n)\n*|(?<=[。！？])|(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"'“‘«(¿¡]*[^\W_a-zß-ÿ]))")
_BLANKS = {c: " " for c in range(128) if not chr(c).isalpha()}
_SHORT = re.compile(r"(?:\b(?:Mio|Mrd|Inc|Ltd|Co|Corp|Nr|No|Mr|Mrs|Ms|Dr|St|bzw|vs|ca|approx|[A-Z])\.)\s*$")
_SPEAKER = re.compile(r"^\s*(?:Analyst|Company|Operator|Q|A)\s*:\s*")
_KANA = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ]")
_LATIN = re.compile(r"[a-zà-öø-ÿāăćčęěğıłńňœřśşšţůűźżž]")


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS x (1 + pairs)
    bias: np.ndarray


def label_language(label: Column) -> Column:
    """The two-letter code a label names in any notation; null if it names none of the languages."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([^\s_-]+)", 1)
    pairs = [F.lit(x) for code, words in NOTATIONS.items() for word in words.split() for x in (word, code)]
    return F.try_element_at(F.create_map(*pairs), base)


def sentences(text: str) -> list[str]:
    """Whole sentences in order; an abbreviation's point doesn't end one."""
    out: list[str] = []
    start = 0
    for m in _SPLIT.finditer(text):
        if "\n" not in m.group() and m.end() > m.start() and _SHORT.search(text[max(start, m.end() - 16) : m.end()]):
            continue
        out.append(text[start : m.end()])
        start = m.end()
    out.append(text[start:])
    return [x for x in (_SPEAKER.sub("", y).strip() for y in out) if x]


def normal(sentence: str) -> str:
    """Lower-case letters and single blanks, a blank at either end."""
    if sentence.isascii():
        return f" {' '.join(sentence.lower().translate(_BLANKS).split())} "
    return " " + re.sub(r"[\W\d_]+", " ", sentence.lower()).strip() + " "


def _grams_by_size(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of run, the hashed runs of all texts in a row, and the text each belongs to, in order."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = points == 10
    owner = np.cumsum(ends)
    out = []
    for n in (2, 3, 4):
        size = len(points) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        inside = np.ones(size, bool)
        for k in range(n):
            h = h * np.uint64(1000003) + points[k : k + size]
            inside &= ~ends[k : k + size]
        h = (h ^ (h >> np.uint64(15))) * np.uint64(2654435761)
        out.append((((h >> np.uint64(12)) % np.uint64(BUCKETS))[inside].astype(np.int64), owner[:size][inside]))
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All of them in one row."""
    parts = _grams_by_size(texts)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([h for h, _ in parts]), np.concatenate([o for _, o in parts])


def _summed(weights: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]], size: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The weights of each text's runs, added up; only of the wanted texts, if given."""
    out = np.zeros((size, *weights.shape[1:]), np.float32)
    for hashes, owners in parts:
        if wanted is not None:
            mine = wanted[owners]
            hashes, owners = hashes[mine], owners[mine]
        if len(owners):
            starts = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
            out[owners[starts]] += np.add.reduceat(weights[hashes], starts, axis=0)
    return out


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """The machines' values for each normalised sentence: the family's first, then those of the languages inside it; the other
    family's are left at nought."""
    out = np.zeros((len(texts), model.weights.shape[1]), np.float32)
    half = 1 + len(FAMILIES["germanic"]) * (len(FAMILIES["germanic"]) - 1) // 2
    columns = [(slice(1, half), np.ascontiguousarray(model.weights[:, 1:half])), (slice(half, None), np.ascontiguousarray(model.weights[:, half:]))]
    family = np.ascontiguousarray(model.weights[:, 0])
    step = 500
    for at in range(0, len(texts), step):
        part = texts[at : at + step]
        parts = _grams_by_size(part)
        n = np.maximum(1, sum((np.bincount(owners, minlength=len(part)) for _, owners in parts), np.zeros(len(part), np.int64)))
        root = np.sqrt(n)
        rows = out[at : at + step]
        rows[:, 0] = _summed(family, parts, len(part)) / root
        germanic = rows[:, 0] + model.bias[0] > 0
        for (where, weights), chosen in zip(columns, (germanic, ~germanic), strict=True):
            if chosen.any():
                rows[chosen, where] = (_summed(weights, parts, len(part), chosen) / root[:, None])[chosen]
    return out + model.bias


def judged(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language (index into LATIN) and confidence of each row of machine values."""
    votes = np.zeros((len(values), len(LATIN)), np.float32)
    weakest = np.full((len(values), len(LATIN)), np.inf, np.float32)
    for k, (a, b) in enumerate(PAIRS, 1):
        v = values[:, k]
        for lang, sign in ((a, 1), (b, -1)):
            i = LATIN.index(lang)
            votes[:, i] += (sign * v > 0) + 0.01 * np.tanh(sign * v)
            weakest[:, i] = np.minimum(weakest[:, i], sign * v)
    half = len(FAMILIES["germanic"])
    votes[values[:, 0] > 0, half:] -= 100
    votes[values[:, 0] <= 0, :half] -= 100
    best = votes.argmax(axis=1)
    margin = np.minimum(np.abs(values[:, 0]), weakest[np.arange(len(values)), best])
    return best, 1 / (1 + np.exp(-4 * margin))


def _machine(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """One linear machine by dual coordinate descent on the squared hinge loss; the bias is a constant feature."""
    w, bias = np.zeros(BUCKETS, np.float64), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1 for _, v in rows]) + 0.5 / cost
    order = np.random.default_rng(7)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gradient = signs[i] * (w[at] @ v + bias) - 1 + alpha[i] * 0.5 / cost
            new = max(0.0, alpha[i] - gradient / norms[i])
            if step := (new - alpha[i]) * signs[i]:
                w[at] += step * v
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-2:
            break
    return w, bias


def agreed(texts: list[str], langs: list[str]) -> np.ndarray:
    """Sentences whose label agrees with the run frequencies of all sentences of each label. Frequencies bear a share of
    wrong labels without harm, where a machine would learn them."""
    hashes, owners = _grams(texts)
    order = np.argsort(owners, kind="stable")
    hashes, owners = hashes[order], owners[order]
    index = np.array([LATIN.index(v) for v in langs])
    counts = np.ones((BUCKETS, len(LATIN)), np.float32) * 0.1
    for k in range(len(LATIN)):
        counts[:, k] += np.bincount(hashes[index[owners] == k], minlength=BUCKETS)
    logs = np.log(counts / counts.sum(axis=0))
    present = np.flatnonzero(np.bincount(index, minlength=len(LATIN)) == 0)
    out = np.zeros(len(texts), bool)
    for at in range(0, len(texts), 2000):
        lo, hi = np.searchsorted(owners, [at, at + 2000])
        n = np.bincount(owners[lo:hi] - at, minlength=min(2000, len(texts) - at))
        has = np.flatnonzero(n)
        if len(has):
            sums = np.add.reduceat(logs[hashes[lo:hi]], np.concatenate([[0], np.cumsum(n[has])[:-1]]), axis=0)
            sums[:, present] = -np.inf
            out[at + has] = sums.argmax(axis=1) == index[at + has]
    return out


def fit(texts: list[str], langs: list[str], cost: float = 1.0, rounds: int = 20) -> Model:
    """All machines on the given sentences."""
    hashes, owners = _grams(texts)
    order = np.argsort(owners, kind="stable")
    ends = np.cumsum(np.bincount(owners, minlength=len(texts)))[:-1]
    rows = []
    for part in np.split(hashes[order], ends):
        at, n = np.unique(part, return_counts=True)
        rows.append((at, n / np.sqrt(max(1, len(part)))))
    index = np.array([LATIN.index(v) for v in langs])
    half = len(FAMILIES["germanic"])
    w, b = np.zeros((BUCKETS, 1 + len(PAIRS)), np.float32), np.zeros(1 + len(PAIRS), np.float32)
    tasks = [(index >= 0, np.where(index < half, 1.0, -1.0))]
    tasks += [((index == LATIN.index(one)) | (index == LATIN.index(other)), np.where(index == LATIN.index(one), 1.0, -1.0)) for one, other in PAIRS]
    for k, (chosen, signs) in enumerate(tasks):
        some = np.flatnonzero(chosen)
        if len(some):
            w[:, k], b[k] = _machine([rows[i] for i in some], signs[some], cost, rounds)
    return Model(w, b)


def labelled_sample(documents: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` documents of each label, by the order of a hash of the id; a bounded set whatever the corpus."""
    rows = documents.select(label_language(F.col(f"`{label}`")).alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`")).alias("__h"))
    rows = rows.where(F.col("lang").isin(*LATIN) & (F.length("text") >= 40))
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("lang").orderBy("__h"))).where(F.col("__n") <= sample).select("lang", "text")


def fitted(documents: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE, each: int = SENTENCES) -> Model:
    texts: list[str] = []
    langs: list[str] = []
    for row in sorted(labelled_sample(documents, key, text, label, sample).collect()):
        for one in sentences(row.text):
            if len(one) >= 30 and not _KANA.search(one):
                texts.append(normal(one))
                langs.append(row.lang)
    if texts:
        # The frequencies take every sentence of the sample, the machines some of each document.
        sure = agreed(texts, langs)
        seen: dict[str, int] = {}
        chosen = []
        for i in np.random.default_rng(5).permutation(len(texts)):
            if sure[i] and seen.get(langs[i], 0) < each * sample:
                seen[langs[i]] = seen.get(langs[i], 0) + 1
                chosen.append(int(i))
        texts, langs = [texts[i] for i in chosen], [langs[i] for i in chosen]
    if not texts:
        return Model(np.zeros((BUCKETS, 1 + len(PAIRS)), np.float32), np.zeros(1 + len(PAIRS), np.float32))
    return fit(texts, langs)


def segments(model: Model, texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
    """For each text its runs of (language, text of the run, confidence)."""
    split = [sentences(t) if t and t.strip() else [] for t in texts]
    flat = [s for one in split for s in one]
    plain = [normal(s) for s in flat]
    best, sure = judged(scores(model, plain)) if flat else (np.zeros(0, int), np.zeros(0))
    out, at = [], 0
    for one in split:
        found: list[list] = []
        for sentence in one:
            letters = len(plain[at]) - plain[at].count(" ")
            narrow = sentence.isascii()
            kana = 0 if narrow else len(_KANA.findall(sentence))
            if kana * 3 >= max(1, letters):
                found.append(["ja", 1.0, kana >= 4, sentence])
            elif (letters if narrow else len(_LATIN.findall(plain[at]))) * 2 >= max(1, letters):
                found.append([LATIN[best[at]], float(sure[at]), letters >= LETTERS and sure[at] >= CERTAIN and " " in plain[at].strip(), sentence])
            else:
                found.append([None, 0.0, False, sentence])
            at += 1
        out.append(_runs(found))
    return out


def _runs(found: list[list]) -> list[tuple[str, str, float]]:
    """Unclear sentences take the language before them, else the one after; with nothing clear, the best guess holds."""
    known = [f for f in found if f[0] is not None]
    if not known:
        return []
    clear = [f for f in known if f[2]]
    if not clear:
        weight: dict[str, float] = {}
        for lang, sure, _, sentence in known:
            weight[lang] = weight.get(lang, 0) + sure * len(sentence)
        top = max(weight, key=lambda k: (weight[k], k))
        return [(top, " ".join(f[3] for f in found), float(np.mean([f[1] for f in known if f[0] == top])))]
    current = clear[0][0]
    runs: list[list] = []
    for lang, sure, is_clear, sentence in found:
        if is_clear:
            current = lang
        if runs and runs[-1][0] == current:
            runs[-1][1].append(sentence)
        else:
            runs.append([current, [sentence], []])
        if is_clear:
            runs[-1][2].append((sure, len(sentence)))
    return [(lang, " ".join(said), sum(s * n for s, n in sures) / max(1, sum(n for _, n in sures))) for lang, said, sures in runs]


_SEGMENTS = "doc_id bigint, label string, n_langs int, segment_no int, lang string, confidence double, text string"


def language_segments(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", with_text: bool = True, model: Model | None = None) -> DataFrame:
    """Every segment: doc_id, label (the code its label names, or null), n_langs of its text, segment_no, lang, confidence, text.
    Without texts, one row per document and language. Repeated rows come out each."""
    machine = model or fitted(documents, key, text, label)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, texts = batch.column("doc_id"), batch.column("label"), batch.column("__text")
            for at in range(0, batch.num_rows, 500):
                rows = {name: [] for name in ("doc_id", "label", "n_langs", "segment_no", "lang", "confidence", "text")}
                part = texts.slice(at, 500).to_pylist()
                for doc, named, runs in zip(ids.slice(at, 500).to_pylist(), labels.slice(at, 500).to_pylist(), segments(machine, part), strict=True):
                    many = len({lang for lang, _, _ in runs})
                    if not with_text:
                        # One row per language: its surest segment.
                        runs = [max((r for r in runs if r[0] == lang), key=lambda r: r[2]) for lang in dict.fromkeys(lang for lang, _, _ in runs)]
                    for number, (lang, said, sure) in enumerate(runs, 1):
                        for name, value in zip(rows, (doc, named, many, number, lang, sure, said if with_text else None), strict=True):
                            rows[name].append(value)
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    chosen = documents.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), label_language(F.col(f"`{label}`")).alias("label"), F.col(f"`{text}`").alias("__text"))
    return chosen.mapInArrow(judge, _SEGMENTS)


def label_errors(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", model: Model | None = None) -> DataFrame:
    """doc_id, lang: each language of each document whose label is missing, names nothing or a language its text isn't in, or whose text is mixed."""
    found = language_segments(documents, key, text, label, with_text=False, model=model)
    # With one language, a label is right only if it is that one; with several, the document is a case anyway.
    cases = found.where("n_langs > 1 or label is null or label <> lang")
    return cases.select("doc_id", "lang")
