"""Repair of text from scanned pages by a noisy-channel model.

Page furniture (running headers, page numbers) is told from body lines by shape and by how often the line, freed of numbers
and folded over the confusable characters, stands alone in the corpus. Words broken over two lines are joined, as one word
or as a compound, whichever the corpus knows better. A word may then be a misreading: candidates are the corpus's words that
character confusions can turn into it, weighed by confusion probabilities and by the likelihood of word pairs in the corpus, and
the best sequence of a line is decoded by Viterbi over the candidates of its words.

Shape of the work: all counts are exact and cover all records, and none is collected or broadcast. One pass counts words, word
pairs and lone lines, and lists the words and lone lines of each part, a part being some ``CHARS_A_PART`` characters of
records. Words and the candidates they may be misreadings of meet by their fold, once for the whole corpus. Each part is then
sent the counts and candidates of its own words, and later those of the word pairs that its undecided lines ask for. So what a
task holds is bounded by its part, and what a record comes out as depends on the corpus alone, not on how it is split.

Defined results: null and blank texts come out empty; text is taken whole; typing slips (swapped, lost or doubled letters)
are left as they are; repeated rows give repeated repairs, and each finding of an id once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fondaco.llm.counts import hash_word, hash_words, mix, mix_one
from fondaco.session import materialise, tasks_of

CHARS_A_PART = 4_000_000
#: Counts that a task holds before it sends them on.
COUNTS_AT_ONCE = 1_000_000

# What a scan shows, what stands there, and how often of all misreadings.
CONFUSIONS = [
    ("c", "e", 0.14), ("l", "i", 0.11), ("!", "i", 0.11), ("0", "o", 0.10), ("@", "a", 0.09), ("f", "t", 0.08), ("ri", "n", 0.08), ("e", "c", 0.05),
    ("5", "s", 0.05), ("i", "l", 0.04), ("1", "l", 0.04), ("rn", "m", 0.03), ("9", "g", 0.02), ("y", "v", 0.02), ("2", "z", 0.015), ("6", "b", 0.01),
    ("g", "q", 0.004), ("li", "h", 0.003), ("m", "rn", 0.003), ("1", "i", 0.002), ("ä", "à", 0.002), ("ë", "è", 0.002), ("ö", "ò", 0.002), ("ü", "ù", 0.002),
    ("n", "ri", 0.03), ("ii", "u", 0.03), ("u", "ii", 0.001), ("h", "li", 0.001), ("d", "cl", 0.002), ("cl", "d", 0.002), ("8", "b", 0.001), ("q", "g", 0.001), ("v", "y", 0.001), ("t", "f", 0.001), ("o", "0", 0.0001), ("ﬁ", "fi", 0.003), ("ﬂ", "fl", 0.001),
]
#: Characters that no word holds: a word with one is misread even if the right word is unknown.
STRANGE = {"0": "o", "1": "l", "5": "s", "6": "b", "8": "b", "9": "g", "2": "z", "!": "i", "@": "a"}
HYPHENS = "-‐­¬"
#: Share of words that are misread, and how much rarer than the right word a misreading must be.
MISREAD, RARER = 0.005, 0.02
#: Words of a greater share of the corpus are no suspects.
FREQUENT = 2e-5

WORD = re.compile(r"[\w!@]+(?:[-‐][\w!@]+)*")
LAST = re.compile(rf"([\w!@]+)[{HYPHENS}]$")
#: Longer runs of letters are no words and stay as they are.
LONGEST = 60
FIRST = re.compile(r"[^\W\d_A-ZÀ-Ý][\w!@]*|[\d!@]+[^\W\d_][\w!@]*")
D = "[0-9lIOoSB]"
PAGE = re.compile(rf"(?:[-–—]\s*{D}+\s*[-–—]|\[\s*{D}+\s*\]|\d{D}*(?:/{D}+)?|{D}*\d{D}*/{D}+|(?:[pP][aA@][gG9]?(?:[iI1l!]n[aA@])?\.?|[pP]\.)\s*{D}+(?:\s*(?:d[iIl1!]|/)\s*{D}+)?)")
PAGED = re.compile(rf"^(?P<left>\d{D}*\s+)?(?P<core>\S.*?)(?P<right>\s*\|\s*{D}+)?$")
TITLE = re.compile(r"(?:cap|volum|massim|rass|part|uff|bollett|sezion|titol|libro|quadern|capit|append|indic|sommar|norm)", re.I)
FOLD = str.maketrans({"1": "l", "i": "l", "!": "l", "0": "o", "@": "a", "5": "s", "9": "g", "6": "b", "2": "z", "c": "e", "f": "t", "y": "v", "q": "g"})


#: The same for whole words, over confusions of several characters too.
DEEP_FOLD = FOLD | str.maketrans({"h": "ll", "u": "ll", "n": "rl", "m": "rrl", "d": "el", "8": "b", "ä": "à", "ë": "è", "ö": "ò", "ü": "ù", "ﬁ": "tl", "ﬂ": "tl"})


def fold(word: str) -> str:
    """Words that confusions can turn into one another have the same fold."""
    return word.translate(DEEP_FOLD)


def _paths(seen: str, true: str, confusions: list[tuple[str, str, float]]) -> float | None:
    """The greatest sum of weights of confusions that show ``true`` as ``seen``, None if no sequence of them does."""
    best: list[float | None] = [None] * (len(true) + 1)
    table = [list(best) for _ in range(len(seen) + 1)]
    table[0][0] = 0.0
    for i in range(len(seen) + 1):
        for j in range(len(true) + 1):
            p = table[i][j]
            if p is None:
                continue
            if i < len(seen) and j < len(true) and seen[i] == true[j]:
                old = table[i + 1][j + 1]
                table[i + 1][j + 1] = p if old is None else max(old, p)
            for s, t, w in confusions:
                if seen.startswith(s, i) and true.startswith(t, j):
                    old, new = table[i + len(s)][j + len(t)], p + w
                    table[i + len(s)][j + len(t)] = new if old is None else max(old, new)
    return table[-1][-1]


def misreading(seen: str, true: str) -> float | None:
    """Log probability that a scan shows one word for another, None if no confusions lead there. One kind counts once, at however many places."""
    apt = [(s, t, math.log(q)) for s, t, q in CONFUSIONS if s in seen and t in true]
    one = [w for s, t, w in apt if _paths(seen, true, [(s, t, 0.0)]) is not None]
    return max(one) if one else _paths(seen, true, apt)


def title_key(core: str) -> str:
    core = re.sub(r"\d+$|(?<=\s)\d+(?=\s|$)", "#", core.lower().strip())
    return re.sub(r"\s+", " ", core.translate(FOLD))


def pieces(line: str) -> tuple[str, bool, bool]:
    """The line without a page number at its side; whether one stood left, right of a bar."""
    m = PAGED.match(line)
    return (m["core"], bool(m["left"]), bool(m["right"])) if m else (line, False, False)


class Lexicon:
    """Counts and candidates of a part of the corpus: words, titles, candidates {word: [(right word, log probability)]}, pairs by key.

    Without pairs it notes which ones are asked for.
    """

    def __init__(self, words: dict[str, int], titles: dict[str, int], fixes: dict[str, list[tuple[str, float]]], pairs: dict[int, int] | None = None):
        self.words, self.titles, self.fixes, self.pairs = words, titles, fixes, pairs
        self.asked: set[int] = set()

    def word(self, w: str) -> int:
        return self.words.get(w, 0)

    def pair(self, a: str, b: str) -> int:
        key = mix_one(hash_word(a)) + hash_word(b) & 2**64 - 1
        if self.pairs is None:
            self.asked.add(key)
            return 0
        return self.pairs.get(key, 0)

    def title(self, core: str) -> int:
        return self.titles.get(title_key(core), 0)


def is_strange(word: str) -> bool:
    return any(c in STRANGE for c in word)


def is_suspect(word: str, own: int, total: float) -> bool:
    """Whether a word of so many occurrences may be a misreading."""
    letters = sum(c.isalpha() for c in word)
    if len(word) > LONGEST or letters < 2 or letters * 2 < len(word) or (len(word) < 3 and not is_strange(word)):
        return False
    return own <= max(3, FREQUENT * total)


class Repairer:
    def __init__(self, lexicon: Lexicon, total: float):
        self.counts, self.total = lexicon, max(total, 1.0)
        self.fixes: dict[str, list[tuple[str, float]]] = {}
        #: Words that stand for themselves.
        self.plain: set[str] = set()

    # Page furniture

    def furniture(self, lines: list[str]) -> list[bool]:
        """Which lines are page furniture."""
        if len(lines) < 2:
            return [False] * len(lines)
        plain = [x.strip() for x in lines]
        width = max(map(len, plain))
        found = []
        for i, s in enumerate(plain):
            found.append(bool(s) and self._is_furniture(lines[i], s, (i > 0 and not plain[i - 1]) or (i + 1 < len(plain) and not plain[i + 1]), width))
        return found

    def _is_furniture(self, line: str, s: str, beside_blank: bool, width: int) -> bool:
        if len(s) <= 40 and PAGE.fullmatch(s):
            return True
        if len(s) > 160 or not (s[0].isupper() or s[0] in "0l1" or s[0].isdigit()) or s[-1] in ".,;:)":
            return False
        core, left, right = pieces(s)
        if right:
            return True
        if len(core) > 80 or core[-1] in ".,;:)" or not (core[0].isupper() or core[0] in "0l1"):
            return False
        letters = [c for c in core if c.isalpha()]
        small = sum(c.islower() and c != "l" for c in letters)
        capitals = len(letters) >= 4 and small <= len(letters) * 0.1
        indented = len(line) - len(line.lstrip()) >= 4
        titled = TITLE.match(core) is not None
        seen = self.counts.title(core)
        if capitals and "," not in core and (indented or beside_blank or left or seen > 1 and len(s) <= 0.8 * width):
            return core[-1] not in HYPHENS
        if indented:
            return len(core) <= 0.85 * width or titled or seen > 2
        short = len(s) <= 0.8 * width
        if core[-1] in HYPHENS or "," in core and not titled:
            return False
        if beside_blank and short and (seen > 1 or titled):
            return True
        if left:
            return titled and (short or seen > 2)
        return titled and (short and seen > 1 or seen > 4) or (short and seen > 4)

    # Misread words

    def hypotheses(self, word: str) -> list[tuple[str, float]]:
        """What may stand for the word, with log probabilities of being read so; only itself if it is no suspect."""
        known = self.fixes.get(word)
        if known is not None:
            return known
        itself = [(word, math.log(1 - MISREAD))]
        found = []
        if is_suspect(word, self.counts.word(word), self.total):
            found = [(w, math.log(MISREAD) + p) for w, p in self.counts.fixes.get(word, ())]
            if not found and is_strange(word):
                w = "".join(STRANGE.get(c, c) for c in word)
                if w.isalpha() and sum(c.isalpha() for c in word) * 5 >= len(word) * 3 and len(word) >= 4:
                    found = [(w, math.log(MISREAD))]
        if not found:
            self.plain.add(word)
        self.fixes[word] = found or itself
        return self.fixes[word]

    def decode(self, read: list[str]) -> list[str]:
        """The likeliest words of a line, by Viterbi over the hypotheses of each."""
        options = [self.hypotheses(w) for w in read]
        if all(len(o) == 1 for o in options):
            return [o[0][0] for o in options]
        counts, mu = self.counts, 20.0
        trail: list[list[int]] = []
        before: list[str] = [""]
        scores = [0.0]
        for o in options:
            now, back = [], []
            for w, p in o:
                if len(o) == 1 and len(before) == 1:
                    now.append(scores[0]), back.append(0)
                    continue
                alone = (counts.word(w) + 0.05) / self.total
                steps = [s + math.log((counts.pair(b, w) + mu * alone) / (counts.word(b) + mu)) if b else s + math.log(alone) for s, b in zip(scores, before)]
                k = max(range(len(steps)), key=steps.__getitem__)
                now.append(steps[k] + p), back.append(k)
            trail.append(back)
            scores, before = now, [w for w, _ in o]
        k = max(range(len(scores)), key=scores.__getitem__)
        out = []
        for o, back in zip(reversed(options), reversed(trail)):
            out.append(o[k][0])
            k = back[k]
        return out[::-1]

    # A record

    def prepare(self, text: str | None) -> tuple[list[str], list[int], list[str], list[str]]:
        """The body lines with broken words joined, which of them are undecided, the joined words, the lines of furniture."""
        if not text or not text.strip():
            return [], [], [], []
        lines = text.split("\n")
        furniture = self.furniture(lines)
        rows = [x.strip() for x, f in zip(lines, furniture) if f]
        body = [x.strip() for x, f in zip(lines, furniture) if not f and x.strip()]
        words: list[str] = []
        joined: list[str] = []
        i = 0
        while i < len(body):
            line = body[i]
            while i + 1 < len(body) and (ends := broken(line, body[i + 1])):
                a, b = ends
                word = self._join(a[1], b[0], line[-1])
                words.append(self.decode([word.lower()])[0])  # a broken word that was misread as well counts as it is put right
                line = line[: a.start()] + word + body[i + 1][b.end() :]
                i += 1
            joined.append(line)
            i += 1
        undecided = []
        for k, line in enumerate(joined):
            read = WORD.findall(line.lower())
            if not self.plain.issuperset(read):
                self.decode(read)  # asks for the pairs it needs
                if not self.plain.issuperset(read):
                    undecided.append(k)
        return joined, undecided, list(dict.fromkeys(words)), rows

    def decide(self, line: str) -> tuple[str, list[str]]:
        """The line with misread words put right, and these words."""
        at = list(WORD.finditer(line))
        read = [m[0].lower() for m in at]
        right = self.decode(read)
        if right == read:
            return line, []
        parts, words, last = [], [], 0
        for m, old, new in zip(at, read, right):
            parts.append(line[last : m.start()])
            if old == new:
                parts.append(m[0])
            else:
                parts.append(new.upper() if m[0].isupper() and len(new) > 1 else new.capitalize() if m[0][0].isupper() else new)
                words.append(new)
            last = m.end()
        return "".join(parts) + line[last:], words

    def _join(self, a: str, b: str, hyphen: str) -> str:
        whole, compound = (a + b).lower(), f"{a}-{b}".lower()
        right = self.decode([whole])[0]
        if hyphen in "-‐" and self.counts.word(compound) > self.counts.word(right):
            return f"{a}-{b}"
        return a + b


def broken(line: str, after: str):
    """The matches of the two halves of a word broken between two lines, None if none is."""
    if line[-1] not in HYPHENS:
        return None
    a = LAST.search(line, max(0, len(line) - LONGEST))
    b = a and FIRST.match(after, 0, LONGEST)
    return (a, b) if b and any(c.isalpha() for c in a[1]) else None


# What the corpus knows

BROKEN = re.compile(rf"(?<!\S)\S+[{HYPHENS}][ \t]*\n\s*\S+")


def _title(s: str) -> str | None:
    """The part of a stripped line that may be a title, None if its shape says that it is none."""
    if len(s) > 160 or not (s[0].isupper() or s[0] in "0l1" or s[0].isdigit()) or s[-1] in ".,;:)":
        return None
    core = pieces(s)[0]
    return core if len(core) <= 80 and core[-1] not in ".,;:)" and (core[0].isupper() or core[0] in "0l1") else None


def joins(lines: list[str]) -> set[str]:
    """All words that joining broken words of a record may give, whichever of its lines are furniture."""
    out: set[str] = set()

    def grow(line: str, i: int) -> None:
        """The line is followed by one of the next lines, up to the first that is no furniture."""
        for j in range(i, len(lines)):
            if not lines[j]:
                continue
            if ends := broken(line, lines[j]):
                a, b = ends
                for word in dict.fromkeys((a[1] + b[0], f"{a[1]}-{b[0]}")):
                    chunk = line[: a.start()].rsplit(None, 1)
                    chunk = (chunk[-1] if chunk and not line[a.start() - 1 : a.start()].isspace() else "") + word
                    rest = lines[j][b.end() :]
                    out.update((word.lower(), *WORD.findall((chunk + (rest.split(None, 1) or [""])[0] if rest[:1].strip() else chunk).lower())))
                    if rest and rest[-1] in HYPHENS and not rest[:-1].strip(HYPHENS):
                        grow(chunk + rest, j + 1)
            if _title(lines[j]) is None and not (len(lines[j]) <= 40 and PAGE.fullmatch(lines[j])) and not pieces(lines[j])[2]:
                return

    for i, line in enumerate(lines):
        if line and line[-1] in HYPHENS:
            grow(line, i + 1)
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (w), word pairs (p) and titles (t) of the corpus; the words (v) and possible titles (u) of each part, counted 0."""
    words, titles, pairs = Counter(), Counter(), [np.zeros(0, np.uint64)]
    own, lone = defaultdict(set), defaultdict(set)
    names = ["kind", "part", "word", "pair", "n"]

    def flush():
        rows = [("w", None, w, n) for w, n in words.items()] + [("t", None, t, n) for t, n in titles.items()]
        rows += [("v", p, w, 0) for p, ws in own.items() for w in ws] + [("u", p, t, 0) for p, ts in lone.items() for t in ts]
        kind, part, word, n = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(part, pa.int32()), pa.array(word, pa.string()), pa.nulls(len(rows), pa.int64()), pa.array(n, pa.int64())], names=names)
        h, n = np.unique(np.concatenate(pairs), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(["p"] * len(h), pa.string()), pa.nulls(len(h), pa.int32()), pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=names)
        for kept in (words, titles, own, lone):
            kept.clear()
        pairs[:] = [np.zeros(0, np.uint64)]

    held = 0
    for batch in batches:
        read: list[str] = []
        ends: list[int] = []
        for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            low = text.lower()
            # A word broken over two lines is no word here, and no pair reaches over a record's end.
            whole = WORD.findall(BROKEN.sub("\n", low))
            read += whole
            ends.append(len(read))
            vocabulary = own[part]
            vocabulary.update(whole)
            lines = [x.strip() for x in text.split("\n")]
            if len(lines) < 2:
                continue
            for m in BROKEN.finditer(low):
                vocabulary.update(WORD.findall(m[0]))
            vocabulary.update(joins(lines))
            for s in lines:
                if s and (core := _title(s)):
                    key = title_key(core)
                    lone[part].add(key)
                    if len(s) <= 80 and core[0].isupper() and not PAGE.fullmatch(s):
                        titles[key] += 1
        if read:
            words.update(read)
            h = hash_words(read)
            across = np.ones(len(h), bool)
            across[np.array(ends, np.int64) % len(h)] = False
            pairs.append((mix(h[:-1]) + h[1:])[across[1:]])
            held += len(read)
        if len(words) + held // 4 + sum(map(len, own.values())) > COUNTS_AT_ONCE:
            held = 0
            yield from flush()
    yield from flush()


def _folder(total: float):
    """Words with their fold, and whether each may be a misreading, of strange characters, or the right word for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
            out = [(fold(w), is_suspect(w, k, total), is_strange(w), k > 0 and len(w) <= LONGEST and all(c.isalpha() or c == "-" for c in w)) for w, k in zip(words, n)]
            columns = zip(*out) if out else ((),) * 4
            types = (pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["word", "n", "fold", "suspect", "strange", "right"])

    return run


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = [misreading(w, r) for w, r in zip(batch.column("word").to_pylist(), batch.column("right").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p"])


def candidates(vocabulary: DataFrame, total: float) -> DataFrame:
    """(word, n, fixes): every word with its count and the right words it may be a misreading of, with log probability and count."""
    folds = materialise(vocabulary.mapInArrow(_folder(total), "word string, n long, fold string, suspect boolean, strange boolean, right boolean"), "folds")
    right = folds.where("right").select("fold", F.col("word").alias("right"), F.col("n").alias("_n"))
    met = folds.where("suspect").select("fold", "word", "n", "strange").join(right, "fold").where(F.col("word") != F.col("right"))
    met = met.where((F.col("_n") >= F.when(F.col("strange"), 1).otherwise(4)) & (F.col("n") <= F.greatest(F.least(F.lit(3.0), F.col("_n") / 3), RARER * F.col("_n"))))
    weighed = met.select("word", "right", "_n").mapInArrow(_weigh, "word string, right string, _n long, p double").where("p is not null")
    fixes = weighed.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("right", "p", F.col("_n").alias("n")))).alias("fixes"))  # words of one fold
    return folds.select("word", "n").join(fixes, "word", "left")


def _lexicon(table: pa.Table, pairs: bool) -> Lexicon:
    words: dict[str, int] = {}
    titles: dict[str, int] = {}
    fixes: dict[str, list[tuple[str, float]]] = {}
    asked: dict[int, int] = {}
    for kind, word, n, found, pair in zip(*(table.column(c).to_pylist() for c in ("kind", "word", "n", "fixes", "pair"))):
        if kind == "v":
            words[word] = n
            if found:
                fixes[word] = [(f["right"], f["p"]) for f in found]
        elif kind == "u":
            titles[word] = n
        else:
            asked[pair & 2**64 - 1] = n
    for found in table.column("fixes").to_pylist():
        for f in found or ():
            words.setdefault(f["right"], f["n"])
    return Lexicon(words, titles, fixes, asked if pairs else None)


DRAFT = "id long, part int, text string, lines array<string>, undecided array<int>, words array<string>, furniture array<string>, pair long"


def _drafter(total: float):
    """Repairs of records without an undecided line; drafts of the others, and the word pairs they ask for."""

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_batches([], schema=_ARROW_DRAFT)
        repairer = Repairer(_lexicon(known, False), total)
        rows = []
        part = texts.column("part")[0].as_py()
        for i, text in zip(texts.column("id").to_pylist(), texts.column("text").to_pylist()):
            lines, undecided, words, furniture = repairer.prepare(text)
            rows.append((i, part, None if undecided else " ".join(lines), lines if undecided else None, undecided or None, words, furniture, None))
        asked = np.fromiter(repairer.counts.asked, np.uint64, len(repairer.counts.asked)).view(np.int64)
        rows += [(None, part, None, None, None, None, None, int(h)) for h in asked]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_DRAFT)], schema=_ARROW_DRAFT)

    return run


def _decider(total: float):
    """Repairs of the records with undecided lines."""

    def run(drafts: pa.Table, known: pa.Table) -> pa.Table:
        repairer = Repairer(_lexicon(known, True), total)
        out = []
        for i, lines, undecided, words, furniture in zip(*(drafts.column(c).to_pylist() for c in ("id", "lines", "undecided", "words", "furniture"))):
            for k in undecided:
                lines[k], right = repairer.decide(lines[k])
                words += right
            out.append((i, " ".join(lines), list(dict.fromkeys(words)), furniture))
        columns = zip(*out) if out else ((),) * 4
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW_REPAIR)], schema=_ARROW_REPAIR)

    return run


_STRINGS = pa.list_(pa.string())
_ARROW_REPAIR = pa.schema([("id", pa.int64()), ("text", pa.string()), ("words", _STRINGS), ("furniture", _STRINGS)])
_ARROW_DRAFT = pa.schema([
    ("id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("lines", _STRINGS), ("undecided", pa.list_(pa.int32())), ("words", _STRINGS), ("furniture", _STRINGS), ("pair", pa.int64()),
])


def repair(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text, words, furniture): the text put right, the words that were broken or misread, the lines of page furniture."""
    texts = rows.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).where("id is not null")
    tasks = tasks_of(rows.sparkSession)
    n, chars = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(2 * tasks, math.ceil((chars or 0) / CHARS_A_PART))
    spread = max(tasks, parts // 2)
    # Records of near ids share a part, so that a task's records fall in few parts where ids follow the order of the files: up to
    # 1,024 ids, fewer where texts are so long that these would be more than an eighth of a part.
    near = int(math.log2(max(1.0, CHARS_A_PART / 8 * n / max(chars or 0, 1))))
    texts = texts.withColumn("part", F.pmod(F.xxhash64(F.shiftright("id", min(near, 10))), F.lit(parts)).cast("int"))
    gathered = texts.select("part", "text").mapInArrow(_gather, "kind string, part int, word string, pair long, n long")
    gathered = materialise(gathered.groupBy("kind", "part", "word", "pair").agg(F.sum("n").alias("n")), "gathered")
    total = float(gathered.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0)
    vocabulary = gathered.where("kind in ('v', 'w')").groupBy("word").agg(F.sum("n").alias("n"))
    known = candidates(vocabulary, total).withColumnRenamed("n", "_n")
    of_part = gathered.where("kind = 'v'").select("kind", "part", "word").join(known, "word").select("kind", "part", "word", F.col("_n").alias("n"), "fixes", F.lit(None).cast("long").alias("pair"))
    titles = gathered.where("kind = 't' and n > 1").select("word", "n")
    no_fixes = F.lit(None).cast("array<struct<right: string, p: double, n: long>>").alias("fixes")
    heads = gathered.where("kind = 'u'").select("kind", "part", "word").join(titles, "word").select("kind", "part", "word", "n", no_fixes, F.lit(None).cast("long").alias("pair"))
    lexicon = materialise(of_part.unionByName(heads), "lexicon")

    by_part = lambda df: df.repartition(spread, "part").groupBy("part")
    drafts = materialise(by_part(texts).cogroup(by_part(lexicon)).applyInArrow(_drafter(total), DRAFT), "drafts")
    counted = gathered.where("kind = 'p'").select("pair", "n")
    pairs = drafts.where("pair is not null").select("part", "pair").join(counted, "pair").select(F.lit("p").alias("kind"), "part", F.lit(None).cast("string").alias("word"), "n", no_fixes, "pair")
    open_ = drafts.where("undecided is not null").select("part", "id", "lines", "undecided", "words", "furniture")
    needed = lexicon.where("kind = 'v'").unionByName(pairs)
    decided = by_part(open_).cogroup(by_part(needed)).applyInArrow(_decider(total), "id long, text string, words array<string>, furniture array<string>")
    return drafts.where("id is not null and undecided is null").select("id", "text", "words", "furniture").unionByName(decided)


def findings(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, kind, item): 'parola' for each word put right, 'riga' for each line of furniture."""
    found = repair(rows, id_column, text_column)
    tag = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))
    items = F.array_distinct(F.concat(tag("words", "parola"), tag("furniture", "riga")))
    return found.select("id", F.explode(items).alias("i")).select("id", "i.kind", "i.item").distinct()
