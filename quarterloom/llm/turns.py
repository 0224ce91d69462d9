"""Raw speech transcripts into clean speaker turns in spoken order.

A transcript is parsed into a tree by a grammar (module peg): a transcript is made of turns and stretches that are nobody's; a turn has a
label, a stamp if there is one, and speech; speech is made of words, annotations within annotations to any depth and length, stamps,
hesitation and closing notes. The heads of turns differ by layout (line labels with or without stamps, angle and voice tags, bold
names, name lines of their own, labels in running text). The tree is then transformed: turns are put in spoken order, labels brought to the
spelling of the directory of people who can speak for the ticker, and speech reduced to its words. A head whose label is
nobody's is no head: its words go on with the turn before. Turns without any word are none, and neighbouring turns of one
speaker are one.

Null and empty transcripts have no turns. Wrongly decoded transcripts are restored before they are read. Speech before the
first head has no speaker and is left out. A ticker without directory keeps Operator and Unidentified Analyst only.
Repeated rows of the directory count once; two people of a ticker with the same short form are told apart by longer forms only.
A turn whose words are all fillers ("You know...") has no clean speech and is none.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterloom.llm import peg
from quarterloom.llm.garble import restore, suspects
from quarterloom.llm.peg import Node
from quarterloom.llm.truncation import without_list

OPERATOR, UNIDENTIFIED = "Operator", "Unidentified Analyst"
#: How far on, in seconds, a text must be for a stamp like its first to mean that it starts over.
RESTART = 90
#: People of a directory up to which it goes to every task, and tickers whose forms of names a task keeps.
PEOPLE_SENT, KEPT = 100_000, 2000
_TURNS = "recent_id bigint, turn_no bigint, speaker string, text string"
# Sounds and fillers of hesitation, headings, notes that close a transcript, short forms of titles.
SOUNDS = r"um+|uh+m?|uhm+|er+m?|ah+|h?mm+|mhm|hm+"
FILLERS = r"you know|i mean|sort of|kind of|like"
HEADINGS = ("prepared remarks", "questions and answers", "question and answer session", "question-and-answer session", "question-and-answer period", "question and answer period", "presentation", "call participants", "participants", "conference call participants", "corporate participants", "webvtt")
TITLE_SHORT = {"ceo": "chief executive officer", "cfo": "chief financial officer", "coo": "chief operating officer", "cto": "chief technology officer", "ir": "head of investor relations"}
NOTES = r"\*{3,}|[—–-]+ ?END ?[—–-]+|\[call ends\]|end of transcript|duration: ?\d+ ?min\w*|\(c\) [^\n]*|goodbye"

# Grammar of small parts.
_TIME = r"\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?"
STAMP = peg.seq(r"[\[(]?", _TIME, r"[\])]?")
# Annotations of one level: tags, starred and sung parts; brackets nest (peg.annotated).
FLAT = peg.compiled(
    peg.choice(
        peg.seq("<", peg.unless("v |[QA] - "), peg.many(r"[^<>\n]", 1), ">"),
        peg.seq(r"\*(?![*\s])", peg.many(r"[^*\n]", 1), r"\*"),
        peg.seq("♪", peg.many(r"[^♪\n]"), "♪"),
    )
)
# What may stand where no word is, once annotations are out: stamps, sounds, rules and all marks.
SILENCE = peg.compiled(peg.many(peg.choice(STAMP, rf"(?:{SOUNDS})\b(?!['’])", r"[\W_]")))
# Each alternative begins with a look at the next letter: most places end there.
_FILLER = re.compile(
    rf"(?:(?<=\s)[-–—] (?:{SOUNDS}|{FILLERS}) [-–—](?=\s)|\b(?=[uehma])(?:{SOUNDS})\b(?:\.\.\.|…|,)?|\b(?=[yiskl])(?:(?<=\s)(?:{FILLERS})(?:\.\.\.|…)|(?<=[\s,])(?:you know|i mean|sort of),?(?=\s)))", re.I
)
_NOTE = re.compile(rf"\s*(?:^|\n|(?<=[.?!] ))(?:{NOTES})\.?\s*$", re.I)
_NOTE_SIGNS = ("***", "- end", "– end", "— end", "-end", "–end", "—end", "call ends", "end of", "uration", "(c)", "oodbye")
# Any sound or filler shows one of these once all but letters is blanks.
_SPACES = bytes(c if chr(c).isalpha() and c < 128 else 32 for c in range(256))
_SOUND_SIGNS = (b" um", b" uh", b" er ", b" err", b" erm", b" ah ", b" ahh", b" hm", b" mm", b" mhm", b"you know", b"i mean", b"sort of", b"kind of", b" like ")
_SPACED = re.compile(r" ([,.;:?!])")
_NOTE_LINE = re.compile(rf"(?:{NOTES})s?\.?", re.I)

# Heads of turns at the start of a line.
_NAME = r"[^\n<>*:]+"
HEAD = peg.compiled(
    peg.choice(
        peg.seq("<v(?:\\.[^ >]*)? ", peg.node("voice", r"[^>\n]*"), ">"),
        peg.seq(r"<[QA] ?- ?", peg.node("side", r"[^>\n]*"), ">:?"),
        peg.seq(r"\*\*", peg.node("bold", r"[^*\n]+"), r"\*\*", peg.maybe(peg.seq(r" ?[\[(]?", peg.node("after", _TIME), r"[\])]?")), ":?"),
        peg.seq(peg.maybe(r">> ?"), peg.maybe(peg.seq(r"[\[(]?", peg.node("before", _TIME), r"[\])]?\s+")), peg.node("line", _NAME), ":", peg.ahead(r"\s|$")),
    )
)
CUE = peg.compiled(peg.seq(peg.node("start", _TIME), r" ?--> ?", _TIME))
_STOPS = (". ", "? ", "! ", "… ", "] ", ") ", "} ", "> ", "* ", "♪ ", '" ', "” ", "- ")
_ENDS = re.compile(r"[.?!:…]$")
_STAMPS = re.compile(rf"(?m)^{STAMP}\s*")


def has_words(speech: str) -> bool:
    """Whether there is a word besides annotations, stamps and sounds."""
    plain = unannotated(speech)
    return SILENCE.match(plain).end() < len(plain)


def unannotated(speech: str) -> str:
    """The speech with a blank for every annotation."""
    if "<" in speech or "*" in speech or "♪" in speech:
        speech = FLAT.sub(" ", speech)
    if "[" in speech or "(" in speech or "{" in speech:
        speech = "".join(p if isinstance(p, str) else " " for p in peg.annotated(speech).parts)
    return speech


def _heading(line: str) -> bool:
    return line.strip(" *#=-:\t").lower() in HEADINGS


def seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


def parse(text: str) -> Node:
    """transcript <- (turn / aside)*: the tree of a transcript. An aside is a stretch under a heading or before the first head."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    first = next((x for x in lines if x.strip() and not _heading(x) and has_words(x)), "")
    tagged = "<v " in text or "<A - " in text or "<Q - " in text or "**" in first
    name_lines = not tagged and not HEAD.match(first) and not _ENDS.search(first.rstrip())
    running = not tagged and not name_lines and _is_running(lines)
    root = Node("transcript", [Node("aside")])
    here: list = root.parts
    cue: float | None = None
    for line in lines:
        bare = line.strip()
        if not bare:
            here[-1].parts.append("\n")
        elif _heading(line):
            # What a heading is followed by, up to the next head, is no speech; in lists of people there is none.
            here.append(Node("aside"))
        elif "-->" in line and (m := CUE.match(bare)):
            cue = seconds(m["start"])
        elif _NOTE_LINE.fullmatch(bare):
            pass
        elif name_lines:
            if not _ENDS.search(bare) and bare[0] != "[" and _may_be_name(bare):
                here.append(Node("turn", [], bare))
            else:
                here[-1].parts.append(line)
        elif running:
            _split_running(line, here)
        elif m := HEAD.match(line):
            stamp = m["before"] or m["after"]
            here.append(Node("turn", [line[m.end() :]], m["voice"] or m["side"] or m["bold"] or m["line"] or "", seconds(stamp) if stamp else cue))
            cue = None
        else:
            here[-1].parts.append(line)
    return root


def _may_be_name(line: str) -> bool:
    """A line of its own that can be a name: short, or in parts set off by dashes (name, title, firm)."""
    return max(len(part) for part in line.split(" -- ")) <= 90


def ordered(tree: Node) -> list[Node]:
    """The turns and asides in spoken order.

    Where heads are stamped, their stamps give the order; a head without stamp stays behind the one before it. A text that
    starts over, with a stamp back near its first, goes on as another part.
    """
    stamps = {i: node.at for i, node in enumerate(tree.parts) if node.at is not None}
    order = _spoken_order(len(tree.parts), stamps) if len(stamps) > 1 else range(len(tree.parts))
    return [tree.parts[i] for i in order]


def heads(text: str) -> list[tuple[str | None, str]]:
    """(label, speech) in spoken order; a label of None opens a stretch that is nobody's speech."""
    return [(node.label, "\n".join(node.parts)) for node in ordered(parse(text))]


def _spoken_order(n: int, stamps: dict[int, float]) -> list[int]:
    first = next(iter(stamps.values()))
    part, now, most, keys = 0, -1.0, first, []
    for i in range(n):
        if i in stamps:
            at = stamps[i]
            # Back at the start from far on: the text begins again.
            if at <= first + 1 and most > first + RESTART:
                part, most = part + 1, at
            now, most = at, max(most, at)
        keys.append((part, now, i))
    return [i for *_, i in sorted(keys)]


def _is_running(lines: list[str]) -> bool:
    """Running text: a line holds several labels, no other line opens with a head, and its own has no stamp. (Else they are lines
    of one turn each with colons in their speech.)"""
    counts = [sum(_label(piece) is not None for piece in line.split(": ")[:-1]) for line in lines]
    fullest = counts.index(max(counts))
    if counts[fullest] < 2 or any("-->" in line for line in lines):
        return False
    opening = [(i, m) for i, line in enumerate(lines) if not _heading(line) and not _NOTE_LINE.fullmatch(line.strip()) and (m := HEAD.match(line)) and len(m["line"] or "") <= 70]
    return all(i == fullest and not m["before"] for i, m in opening)


def _label(piece: str) -> str | None:
    """The label a piece before a colon ends with: what follows the last end of a sentence, if short."""
    tail = piece[-90:]
    label = tail[max(tail.rfind(stop) + len(stop) if stop in tail else 0 for stop in _STOPS) :]
    return label if 0 < len(label) <= 70 and label.count(" ") <= 7 and not label[0].isdigit() else None


def _split_running(line: str, out: list[Node]) -> None:
    pieces = line.split(": ")
    for piece in pieces[:-1]:
        label = _label(piece)
        if label is None:
            out[-1].parts.append(piece + ":")
        else:
            out[-1].parts.append(piece[: len(piece) - len(label)])
            out.append(Node("turn", [], label))
    out[-1].parts.append(pieces[-1])


def fold(name: str) -> str:
    """Without case, marks and doubled blanks."""
    if name.isascii():
        return " ".join(name.casefold().split())
    plain = unicodedata.normalize("NFKD", name.casefold())
    return re.sub(r"\s+", " ", "".join(c for c in plain if not unicodedata.combining(c))).strip()


def one_lost(a: str, b: str) -> bool:
    """Whether two words are equal once each has lost at most one character (a slip, or a swap of neighbours)."""
    if abs(len(a) - len(b)) > 1:
        return False
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[start : len(a) - tail], b[start : len(b) - tail]
    # They differ at both ends: one loses its first, the other its last character.
    return (len(x) <= 1 and len(y) <= 1) or x[1:] == y[:-1] or x[:-1] == y[1:]


def slips(a: str, b: str) -> int:
    """Edits and swaps of neighbours between two words; a lost character of the first stands for any."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y and x not in "?�"))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


class Directory:
    """The people who can speak for one ticker, and every form a label may give them."""

    def __init__(self, people: list[tuple[str, str | None]]):
        forms: dict[str, set[str]] = {}
        self._whole: list[tuple[str, str]] = []
        add = lambda form, name: forms.setdefault(form, set()).add(name)
        self.titles: dict[str, set[str]] = {}
        self.words: set[str] = set()
        for name, title in dict.fromkeys(people):
            folded = fold(name)
            parts = folded.split(" ")
            first, last = parts[0], parts[-1]
            if title:
                self.titles.setdefault(fold(title), set()).add(name)
            for form in (folded, last, f"{first[:1]}. {last}", f"{first[:1]} {last}", f"{last} {first}", f"{last} {first[:1]}", f"{last} {first[:1]}."):
                add(form, name)
            if first != last:
                add(first, name)
            # Lost characters: the forms without any letter beyond ASCII.
            for form in (name, name.split(" ")[-1]):
                add("\0" + re.sub(r"[^a-z ]", "", form.casefold()), name)
            self._whole += [(form, name) for form in (folded, last, f"{last} {first}")]
        self.forms = {form: next(iter(names)) for form, names in forms.items() if len(names) == 1}
        self.known: dict[str, str | None] = {}

    def near(self, form: str) -> str | None:
        """The one person with a form that is this one but for one character lost in either or both."""
        names = {name for other, name in self._whole if one_lost(form, other)}
        return names.pop() if len(names) == 1 else None

    def name(self, label: str) -> str | None:
        if label not in self.known:
            self.known[label] = self._name(label)
        return self.known[label]

    def _name(self, label: str) -> str | None:
        # Most labels are a form as it stands.
        plain = fold(label)
        if plain == "operator":
            return OPERATOR
        if plain in self.forms:
            return self.forms[plain]
        label = "".join(p if isinstance(p, str) else p.text() if p.parts[0] == "(" else " " for p in peg.annotated(FLAT.sub(" ", label)).parts).strip(" *>#\t")
        label = re.sub(r"^(?:[QA] ?- ?|>> ?)", "", label)
        label = label.split(" -- ")[0].split(" – ")[0].split(" — ")[0]
        role = None
        if m := re.search(r"\s*\(([^()]*)\)\s*$", label):
            label, role = label[: m.start()], m[1]
        folded = fold(label)
        if re.search(r"\b(?:operator|moderator|coordinator)\b", folded):
            return OPERATOR
        if re.search(r"\b(?:unidentified|unknown|unnamed)\b", folded):
            return UNIDENTIFIED
        if found := self._person(folded, label):
            return found
        if "," in folded:
            before, _, after = folded.partition(",")
            before, after = before.strip(), after.strip()
            if found := self._person(f"{after} {before}", f"{after} {before}") or self._person(before, before) or self._title(after):
                return found
        if folded in ("analyst", "participant", "unidentified"):
            return UNIDENTIFIED
        for lead in ("analyst ", "mr. ", "ms. ", "mrs. ", "dr. ", "mr ", "ms "):
            if folded.startswith(lead) and (found := self._person(folded[len(lead) :], label[len(lead) :])):
                return found
        if found := self._title(folded) or (role and self._title(fold(role))):
            return found
        words = folded.split(" ")
        # In running text the words before a label may have been taken along.
        for k in range(1, len(words)):
            rest = " ".join(words[k:])
            if found := self.forms.get(rest):
                return found
            if rest in ("operator", "unidentified analyst"):
                return OPERATOR if rest == "operator" else UNIDENTIFIED
        for k in range(max(0, len(words) - 2), len(words)):
            if found := self._nearest(" ".join(words[k:])):
                return found
        return None

    def _nearest(self, folded: str) -> str | None:
        """The one person whose name differs by at most two slips, a lost character being none."""
        if len(folded) < 6:
            return None
        ranked = sorted((slips(folded, form), name) for form, name in self.forms.items() if not form.startswith("\0") and abs(len(form) - len(folded)) <= 2 and len(form) >= 6)
        names = {name for n, name in ranked if ranked and n == ranked[0][0]}
        return ranked[0][1] if ranked and len(names) == 1 and ranked[0][0] <= (2 if len(folded) >= 9 else 1) else None

    def _title(self, folded: str) -> str | None:
        names = self.titles.get(TITLE_SHORT.get(folded, folded), ())
        return next(iter(names)) if len(names) == 1 else None

    def _person(self, folded: str, label: str) -> str | None:
        if folded in self.forms:
            return self.forms[folded]
        if "?" in label or "�" in label:
            plain = "\0" + re.sub(r"[^a-z ]", "", label.casefold())
            if plain in self.forms:
                return self.forms[plain]
        if len(folded) >= 5:
            if found := self.near(folded):
                return found
            if "?" in folded or "�" in folded:
                return self.near(re.sub(r"[?�]", "", folded))
        return None


def clean(speech: str) -> str:
    """Speech without annotations, stamps and hesitation, in one line. Each step runs only where its plainest sign occurs."""
    speech = without_list(speech)
    low = speech.lower()
    if any(sign in low for sign in _NOTE_SIGNS):
        speech = _NOTE.sub("", speech)
    if ":" in speech:
        speech = _STAMPS.sub("", speech)
    speech = unannotated(speech)
    spaced = b" %b " % low.encode("ascii", "replace").translate(_SPACES)
    if any(sign in spaced for sign in _SOUND_SIGNS):
        speech = _FILLER.sub(" ", speech)
    return _SPACED.sub(r"\1", " ".join(speech.split())).strip(" -–—")


def assemble(people: Directory, labels: list[str | None], speech: list[str]) -> list[tuple[str, str]]:
    """(speaker, text) of each turn, from labels and clean speech in order."""
    turns: list[tuple[str, list[str]]] = []
    current: list[str] | None = None
    for label, said in zip(labels, speech, strict=True):
        name = people.name(label) if label is not None else None
        if name is not None:
            current = [said]
            turns.append((name, current))
        elif label is None:
            # A stretch under a heading is nobody's.
            current = None
        elif current is not None:
            # An unknown label is part of the speech before it.
            current.append(f"{unannotated(label).strip()}: {said}" if said.strip() else unannotated(label).strip())
    out: list[tuple[str, str]] = []
    for name, texts in turns:
        said = " ".join(t for t in texts if t)
        if SILENCE.match(said).end() == len(said):
            continue
        if out and out[-1][0] == name:
            out[-1] = (name, f"{out[-1][1]} {said}")
        else:
            out.append((name, said))
    return out


def _utterances(texts: pa.Array) -> Iterator[tuple[list[str | None], list[str]]]:
    """Labels and clean speech of each transcript, in spoken order."""
    doubtful = suspects(texts)
    for row, value in enumerate(texts.to_pylist()):
        nodes = ordered(parse(restore(value or "")[0] if doubtful[row] else value or ""))
        yield [n.label for n in nodes], [clean("\n".join(n.parts)) for n in nodes]


_LISTS = pa.list_(pa.string())


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, speech = zip(*_utterances(batch.column("__text")), strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__ticker"), pa.array(labels, _LISTS), pa.array(speech, _LISTS)], names=["__id", "__ticker", "labels", "speech"])


def _turn_batch(rows: list[tuple[int, int, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["recent_id", "turn_no", "speaker", "text"])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ticker, people = None, Directory([])
    for batch in batches:
        rows: list[tuple] = []
        for row in batch.to_pylist():
            if row["__ticker"] != ticker:
                ticker = row["__ticker"]
                people = Directory([(p["speaker"], p["title"]) for p in row["people"] or [] if p["speaker"]])
            rows += [(row["__id"], number, *turn) for number, turn in enumerate(assemble(people, row["labels"], row["speech"]), 1)]
        yield _turn_batch(rows)


def _beside(shared):
    """Parsing and naming where a transcript is read, with the whole directory at hand."""
    ready: list[dict[str, Directory]] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Directory] = {}
        for batch in batches:
            if not ready:
                ready.append(dict(shared.value))
            tickers, ids = batch.column("__ticker").to_pylist(), batch.column("__id").to_pylist()
            rows: list[tuple] = []
            for key, ticker, (labels, speech) in zip(ids, tickers, _utterances(batch.column("__text")), strict=True):
                if ticker not in known:
                    if len(known) >= KEPT:
                        known.clear()
                    known[ticker] = Directory(ready[0].get(ticker, []))
                rows += [(key, number, *turn) for number, turn in enumerate(assemble(known[ticker], labels, speech), 1)]
            yield _turn_batch(rows)

    return run


def speaker_turns(records: DataFrame, speakers: DataFrame, key: str = "recent_id", ticker: str = "ticker", text: str = "transcript", sent: int = PEOPLE_SENT) -> DataFrame:
    """recent_id, turn_no, speaker, text of every turn.

    A directory of at most ``sent`` people goes to every task, and nothing is shuffled; a larger one meets the parsed
    transcripts in a join by ticker, with the same result.
    """
    raw = records.select(F.col(f"`{key}`").cast("bigint").alias("__id"), F.col(f"`{ticker}`").alias("__ticker"), F.col(f"`{text}`").alias("__text")).where("length(__text) > 0")
    known = speakers.where("speaker is not null and ticker is not null").select(F.col("ticker").alias("__ticker"), "speaker", "title").distinct()
    if known.count() <= sent:
        lists: dict[str, list[tuple[str, str | None]]] = {}
        for r in sorted(known.collect(), key=lambda r: (r[0], r.speaker, r.title or "")):
            lists.setdefault(r[0], []).append((r.speaker, r.title))
        return raw.mapInArrow(_beside(records.sparkSession.sparkContext.broadcast(lists)), _TURNS)
    parsed = raw.mapInArrow(_parsed, "__id bigint, __ticker string, labels array<string>, speech array<string>")
    directory = known.groupBy("__ticker").agg(F.sort_array(F.collect_list(F.struct("speaker", "title"))).alias("people"))
    joined = parsed.join(directory, "__ticker", "left").select("__id", "__ticker", "labels", "speech", "people")
    return joined.mapInArrow(_resolved, _TURNS)
