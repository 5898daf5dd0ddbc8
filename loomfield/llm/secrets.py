"""Secret scans: base patterns, and formats of credentials learnt by grammar inference.

The automata are learnt as stochastic regular grammars are: a prefix tree over labelled credentials, whose states are
merged wherever their outgoing frequencies are statistically compatible (a Hoeffding bound, checked down both
subtrees). Every candidate string of a text is then scored by its log-likelihood under the automaton of each
format against a background automaton of ordinary words; the best difference for each character decides.
Credentials are labelled by the base patterns in the corpus and by the published formats below, of which examples are drawn.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import string
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions.common import Tables
from loomfield.llm.base import slices, text_or_empty

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the leftmost runs of [0-9a-f] with 24 or more
#: Runs of credential characters: what the background learns from, and the candidates that the automata score.
CANDIDATE_CHARS = 16
RUN, CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{4,}"), re.compile(r"[A-Za-z0-9+/_=-]{16,}")

ALNUM = string.ascii_letters + string.digits
#: Published formats of credentials, as (text, or characters and how many of them).
PUBLISHED = {
    "github": ("ghp_", (ALNUM, 36)),
    "gitlab": ("glpat-", (ALNUM + "_-", 20)),
    "stripe": ("sk_live_", (ALNUM, 24)),
    "slack": ("xoxb-", (string.digits, 12), "-", (string.digits, 12), "-", (ALNUM, 24)),
    "google": ("AIza", (ALNUM + "_-", 35)),
    "npm": ("npm_", (ALNUM, 36)),
    "cloud_secret": ((ALNUM + "+/", 40),),
    "base64_32": ((ALNUM + "+/", 43), "="),
    "upper_hex": ((string.digits + "ABCDEF", 40),),
}

#: What fitting takes at most: labelled credentials of each kind, background runs, and unlabelled candidates to set the threshold;
#: always the distinct strings of smallest hash. Longer strings than LONGEST aren't learnt from.
FIT_CREDENTIALS, FIT_WORDS, FIT_CANDIDATES, LONGEST = 2_000, 6_000, 4_000, 256
#: Examples drawn of each published format, and the share of all strings (1 in HELD_OUT) that only sets the threshold.
EXAMPLES, HELD_OUT = 300, 5
#: Names made of the corpus's own words, rules of repeated marks and plain numbers, which the background learns besides the runs as they stand.
NAMES, RULES, NUMBERS = 3_000, 500, 500
#: Confidence of the merge test; what a false finding weighs against a missed credential; the least gain in nats a character.
ALPHA, FALSE_WEIGHT, LEAST_GAIN = 0.05, 20.0, 0.1
#: What every automaton gives to a move by chance, seen or not, and the symbols (with the end) that share it.
CHANCE, N_SYMBOLS = 0.1, 17


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base matches, in the order start, kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def symbol(c: str) -> str:
    """The alphabet of the automata: classes of characters, so that one format needs few samples; vowels stand apart, since words alternate and keys don't."""
    if c in string.digits:
        return "0"
    if c in string.ascii_letters:
        low = c.lower()
        group = "e" if low in "ae" else "f" if low in "bcdf" else "o" if low in "iou" else "z"
        return group if c == low else group.upper()
    return c if c in "+/_=-." else "?"


SYMBOLS = {chr(c): symbol(chr(c)) for c in range(128)}


def word_symbols(word: str) -> str:
    return "".join([SYMBOLS.get(c, "?") for c in word])


UNSEEN = math.log(CHANCE / N_SYMBOLS)


class Automaton:
    """A probabilistic automaton inferred from words over the symbols."""

    def __init__(self, words: dict[str, int], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.ends: list[int] = [0]
        self.seen: list[int] = [0]
        for word, n in sorted(words.items()):
            state = 0
            for c in word:
                self.seen[state] += n
                self.count[state][c] += n
                if c not in self.next[state]:
                    self.next[state][c] = self._state()
                state = self.next[state][c]
            self.seen[state] += n
            self.ends[state] += n
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.logs = [self._log(s) for s in range(len(self.next))]

    def _state(self) -> int:
        self.next.append({})
        self.count.append(defaultdict(int))
        self.ends.append(0)
        self.seen.append(0)
        return len(self.next) - 1

    def _differs(self, x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > self.alpha * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if self._differs(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if self._differs(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b] and self.next[a][c] != self.next[b][c]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self) -> None:
        """Red states stay; a blue child of a red state merges with the first compatible red state or turns red."""
        red = [0]
        blue = [(0, c) for c in sorted(self.next[0])]
        while blue:
            parent, c = blue.pop(0)
            state = self.next[parent][c]
            if state in red:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = sorted({(r, d) for r in red for d, s in self.next[r].items() if s not in known})

    def compact(self) -> Automaton:
        """Itself with only those states that a word can still reach, which is what tasks are sent."""
        number, todo = {0: 0}, [0]
        for s in todo:
            for t in self.next[s].values():
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
        self.next = [{c: number[t] for c, t in self.next[s].items()} for s in todo]
        self.count, self.ends, self.seen = ([x[s] for s in todo] for x in (self.count, self.ends, self.seen))
        self.logs = [self._log(s) for s in range(len(todo))]
        return self

    def _log(self, s: int) -> tuple[dict[str, tuple[float, int]], float]:
        """Moves and the end as logarithms. All automata mix their frequencies with the same chance, so that a symbol none has seen weighs alike in all."""
        total, least = max(self.seen[s], 1), CHANCE / N_SYMBOLS
        p = lambda n: math.log((1 - CHANCE) * n / total + least)
        return {c: (p(n), self.next[s][c]) for c, n in self.count[s].items()}, p(self.ends[s])

    def score(self, word: str, restart: bool = False) -> float:
        """Log-likelihood of a word; where the automaton has no move, the rest is chance, or with restart that symbol alone, after which a word begins."""
        state, total = 0, 0.0
        for i, c in enumerate(word):
            moves, _ = self.logs[state]
            if c in moves:
                p, state = moves[c]
                total += p
            elif restart:
                total += UNSEEN
                state = self.logs[0][0].get(c, (0.0, 0))[1]
            else:
                return total + (len(word) - i + 1) * UNSEEN
        return total + self.logs[state][1]


class Model(NamedTuple):
    """Automata by format, the background's, the gain that makes a candidate a secret, and what held-out strings say of it."""

    formats: dict[str, Automaton]
    ordinary: Automaton
    threshold: float
    recall: float
    false_rate: float


def published_examples(n: int = EXAMPLES) -> dict[str, list[str]]:
    """n examples of each published format, the same ones always."""
    rng = random.Random(7)
    draw = lambda part: part if isinstance(part, str) else "".join(rng.choices(part[0], k=part[1]))
    return {name: ["".join(map(draw, parts)) for _ in range(n)] for name, parts in PUBLISHED.items()}


def ordinary_examples(words: list[str], names: int = NAMES, rules: int = RULES, numbers: int = NUMBERS) -> list[str]:
    """Names as sources write them, joined from the alphabetic words among these (none: no names), rules of repeated marks, and numbers, dates among them; the same ones always."""
    rng = random.Random(11)
    parts = sorted({w.lower() for w in words if w.isalpha() and len(w) <= 14})
    found = []
    for _ in range(names if parts else 0):
        some = []
        for w in rng.choices(parts, k=rng.randint(2, 7)):  # as it stands, cut short, or without its vowels; now and then with a number
            way = rng.random()
            w = w[: rng.randint(1, 4)] if way < 0.12 else (re.sub("[aeiou]", "", w) or w) if way < 0.24 else w
            some.append(w + str(rng.randint(0, 999)) if rng.random() < 0.12 else w)
        if rng.random() < 0.15:
            some.insert(rng.randint(1, len(some)), str(rng.randint(0, 9999)))
        style = rng.randrange(8)
        if style < 3:  # snake, constant, special
            name = "_".join(some)
            name = (name, name.upper(), f"__{name}__")[style]
        elif style < 5:  # camel, with or without a first capital
            name = "".join(w.capitalize() for w in some)
            name = name if style == 3 else some[0] + name[len(some[0]) :]
        else:  # kebab, path, path of camel names
            name = ("-".join(some), "/".join(some), "/".join(w.capitalize() for w in some))[style - 5]
        found.append(rng.choice(("", "", "", "_", "/", "-", "--")) + name)
    for _ in range(rules):
        mark, corner = rng.choices("-=_/+*", k=2)
        n = rng.randint(4, 60)
        found.append((mark * n if rng.random() < 0.6 else corner + (mark * (n // 3 + 1) + corner) * rng.randint(1, 4)).replace("*", "-"))
    for _ in range(numbers):
        digits = "".join(rng.choices(string.digits, k=rng.randint(4, 48)))
        found.append(rng.choice(("", "", "", "-", "+")) + (digits if rng.random() < 0.8 else f"{digits[:4]}-{digits[4:6]}-{digits[6:]}"))
    return found


def held_out(value: str) -> bool:
    return zlib.crc32(value.encode()) % HELD_OUT == 0


def training_strings(text: str, longest: int) -> Iterable[tuple[str, str]]:
    """(kind, string) of a text: base matches by kind (assign by its value), runs that no base span touches as word, and long ones as candidate too."""
    base = base_spans(text)
    for kind, start, end in base:
        value = ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]
        if len(value) <= longest:
            yield kind, value
    touched = overlaps(base)
    for m in RUN.finditer(text):
        start, end = m.span()
        if end - start <= longest and not (base and touched(start, end)):
            yield "word", m.group()
            if end - start >= CANDIDATE_CHARS:
                yield "candidate", m.group()


def fit_formats(docs: DataFrame, text_col: str = "text", credentials: int = FIT_CREDENTIALS, words: int = FIT_WORDS, candidates: int = FIT_CANDIDATES, longest: int = LONGEST) -> Model:
    """Automata of the labelled credentials by kind and of the published formats, one of ordinary words, and the threshold between them.

    The base matches label the corpus's credentials: assign by the assigned value. The samples are bounded by the parameters: of each
    kind the distinct strings of smallest hash, no string over longest characters; every text is read whole. One string in HELD_OUT
    is kept from the automata; the threshold is the gain that loses fewest held-out credentials, a false finding among held-out
    candidates that no base pattern labels weighing FALSE_WEIGHT. A null or empty text gives nothing; a kind without a labelled
    string has no automaton; an empty table leaves the published formats against an empty background.
    """
    bounds = dict.fromkeys(KINDS, credentials) | {"word": words, "candidate": candidates}

    def run(batches):
        least: dict[str, dict[str, int]] = {k: {} for k in bounds}  # the strings of smallest hash of this task
        cut = dict.fromkeys(bounds, 1 << 32)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                for kind, value in set(training_strings(text, longest)):
                    h = zlib.crc32(value.encode())
                    if h <= cut[kind]:
                        least[kind][value] = h
                for kind, n in bounds.items():
                    if len(least[kind]) > 2 * n:
                        kept = heapq.nsmallest(n, least[kind].items(), key=lambda x: (x[1], x[0]))
                        least[kind], cut[kind] = dict(kept), kept[-1][1]
        rows = [(k, v, h) for k, n in bounds.items() for v, h in heapq.nsmallest(n, least[k].items(), key=lambda x: (x[1], x[0]))]
        yield pa.RecordBatch.from_pydict(dict(zip(("kind", "value", "h"), map(list, zip(*rows, strict=True)) if rows else ([], [], []), strict=True)), schema=pa.schema([("kind", pa.string()), ("value", pa.string()), ("h", pa.int64())]))

    found = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(run, "kind string, value string, h long").distinct()
    with Tables(docs.sparkSession, "secret-strings") as tables:
        found = tables.write(found, "strings")
        by = {k: [r["value"] for r in found.where(F.col("kind") == k).orderBy("h", "value").limit(n).collect()] for k, n in bounds.items()}
    return fit_model({k: by[k] for k in KINDS} | published_examples(), by["word"], by["candidate"])


def fit_model(labelled: dict[str, list[str]], words: list[str], candidates: list[str]) -> Model:
    """The model of labelled strings by format, background words with names and rules made of them, and candidates that nothing labels; each string counts once."""

    def learn(values: Iterable[str]) -> Automaton:
        counts: dict[str, int] = defaultdict(int)
        for value in values:
            if not held_out(value):
                counts[word_symbols(value)] += 1
        return Automaton(dict(counts)).compact()

    made = ordinary_examples(words)
    formats = {k: learn(values) for k, values in labelled.items() if any(not held_out(v) for v in values)}
    ordinary = learn([*words, *made])
    yes = sorted(gain(v, formats, ordinary) for values in labelled.values() for v in values if held_out(v))
    no = sorted(gain(v, formats, ordinary) for v in [*candidates, *(v for v in made if len(v) >= CANDIDATE_CHARS)] if held_out(v))
    recall = lambda t: (len(yes) - bisect_left(yes, t)) / max(len(yes), 1)
    false = lambda t: (len(no) - bisect_left(no, t)) / max(len(no), 1)
    scores = sorted({*yes, *no})
    cuts = [t for t in ((a + b) / 2 for a, b in zip(scores, scores[1:])) if t >= LEAST_GAIN] or [LEAST_GAIN]
    best = max(recall(t) - FALSE_WEIGHT * false(t) for t in cuts)
    best_cuts = [t for t in cuts if recall(t) - FALSE_WEIGHT * false(t) == best]
    threshold = best_cuts[len(best_cuts) // 2]
    return Model(formats, ordinary, threshold, recall(threshold), false(threshold))


def gain(word: str, formats: dict[str, Automaton], ordinary: Automaton) -> float:
    """The best format's log-likelihood over the background's, for each symbol; the background knows a word in capitals as the same word in small letters too."""
    if not formats or not word:
        return -math.inf
    symbols = word_symbols(word)
    plain = ordinary.score(symbols, restart=True)
    if word.isupper():
        plain = max(plain, ordinary.score(word_symbols(word.lower()), restart=True))
    return (max(a.score(symbols) for a in formats.values()) - plain) / (len(symbols) + 1)


def overlaps(base: list[tuple[str, int, int]]):
    """Whether a place (start, end) shares a character with any of the spans, which stand in the order of their starts."""
    starts = [s for _, s, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))
    return lambda start, end: (at := bisect_left(starts, end)) > 0 and reach[at - 1] > start


def learnt_spans(text: str, base: list[tuple[str, int, int]], model: Model) -> list[tuple[str, int, int]]:
    touched = overlaps(base)
    found = []
    for m in CANDIDATE.finditer(text):
        if not (base and touched(*m.span())) and gain(m.group(), model.formats, model.ordinary) >= model.threshold:
            found.append(("format", *m.span()))
    return found


def scan_secrets(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, spans array<struct<kind, start, end, base>> in the order start, kind; code points, end exclusive.

    Kinds: assign, access, hex (base) and format (the automata's; only where no base span overlaps). Every run of 16 or more
    credential characters is scored. A null or empty text has no spans. Ids may be null or repeat; each row is scanned alone.
    Other columns are ignored. Without a labelled credential in docs the published formats alone are learnt.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or fit_formats(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    order = {k: i for i, k in enumerate((*KINDS, "format"))}

    def run(batches):
        known = sent.value
        for part in slices(batches):
            out = []
            for text in part.column(1).to_pylist():
                base = base_spans(text)
                spans = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in learnt_spans(text, base, known)]
                out.append([dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in sorted(spans, key=lambda x: (x[1], order[x[0]]))])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(span))], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    return found.select(F.col("id").alias(id_col), "spans")


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *(count(k) for k in KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
