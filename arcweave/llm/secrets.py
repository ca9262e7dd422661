"""Secret scans: fixed patterns, and formats learned from what they find.

Credentials that the patterns label are put into a prefix tree over a token's
length, its case and the kinds of its characters. States are merged where their
counts are statistically alike (Hoeffding's bound, from the root outwards), which
gives a probabilistic automaton of each kind's format. Every token of LEAST_TOKEN
characters that no base span holds whole is a candidate, scored by how much likelier
these automata make it than the tokens of ordinary text, of which all are counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import scratch, written

#: The base patterns, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12
KINDS = ("assign", "access", "hex", "format")
#: Words without which ASSIGN finds nothing, in any case.
CUES = (b"passw", b"secret", b"token", b"api")
#: Tokens that the automata score: whole runs of these characters, of this length at least.
LEAST_TOKEN = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Credentials of each kind that the formats are learned from: those of the smallest hash.
SAMPLE = 1500
#: Nats by which a format must make a token likelier than ordinary text does: odds of ten thousand to one.
GAIN = math.log(10_000)

#: Kinds of characters; what a kind's characters are is alike in formats and in ordinary tokens. Marks are kinds of their own.
_CLASS = str.maketrans({**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdefABCDEF", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", "l")})
#: Other bytes than those of CANDIDATE become blanks.
_KEPT = bytes(i if CANDIDATE.match(chr(i)) else 32 for i in range(256))
_HEX_RUN = re.compile(rb"[0-9a-f]{16}")
#: As smoothing counts them: kinds of characters, lengths, cases.
_SYMBOLS, _LENGTHS, _CASES = 3 + 6, 80, 4


def long_tokens(text: str) -> tuple[bytes, list[bytes]]:
    """A text's bytes, and its tokens of LEAST_TOKEN characters, without their places."""
    data = text.encode("utf-8", "surrogatepass")
    return data, [t for t in data.translate(_KEPT).split() if len(t) >= LEAST_TOKEN]


def base_spans(text: str, data: bytes | None = None, tokens: list[bytes] | None = None) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, credential) of the fixed patterns' finds, in the order they are listed.

    A pattern with a least length finds the same as one without whose short finds
    are dropped, for AKIA and hex: what is short there ends where its run ends. Each
    is run only where its bytes show that it finds something.
    """
    if data is None:
        data, tokens = long_tokens(text)
    found = []
    if any(len(t) >= 16 and _HEX_RUN.search(t) for t in tokens):
        found += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text)]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text)]
    low = data.lower()
    if any(c in low for c in CUES):
        found += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    return sorted(found)


def candidates(text: str, base: Sequence[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """(start, token) of the tokens that the automata score, all but those inside one base span."""
    return [(m.start(), m.group()) for m in CANDIDATE.finditer(text) if m.end() - m.start() >= LEAST_TOKEN and not any(s <= m.start() and m.end() <= e for s, _, e, _ in base)]


def symbols(token: str) -> str:
    """Case (0 no letters, 1 lower, 2 upper, 3 both), length (in steps of doubling past 64), kinds of characters."""
    n = len(token)
    kinds = token.translate(_CLASS)
    case = 1 if token.islower() else 2 if token.isupper() else 3 if "h" in kinds or "l" in kinds else 0
    return f"{case}{chr(256 + (n if n <= 64 else 58 + n.bit_length()))}{kinds}"


@dataclass
class State:
    """seen: strings that came here; ended: of these, how many ended here."""

    seen: int = 0
    ended: int = 0
    after: dict[str, State] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton of strings over kinds of characters."""

    def __init__(self, strings: Counter, alpha: float = 0.05):
        self.root = State()
        for string, n in strings.items():
            state = self.root
            state.seen += n
            for c in string:
                state = state.after.setdefault(c, State())
                state.seen += n
            state.ended += n
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _apart(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 and n2 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _alike(self, a: State, b: State) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if self._apart(a.ended, a.seen, b.ended, b.seen):
                return False
            for c in {*a.after, *b.after}:
                x, y = a.after.get(c), b.after.get(c)
                if self._apart(x.seen if x else 0, a.seen, y.seen if y else 0, b.seen):
                    return False
                if x and y and x is not y:
                    stack.append((x, y))
        return True

    @staticmethod
    def _fold(a: State, b: State) -> None:
        """Adds the tree under b to a; what a lacks moves over."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            a.seen, a.ended = a.seen + b.seen, a.ended + b.ended
            for c, y in b.after.items():
                if c in a.after:
                    stack.append((a.after[c], y))
                else:
                    a.after[c] = y

    def _merge(self) -> None:
        red = [self.root]
        while True:
            ids = {id(r) for r in red}
            blue = [(-y.seen, i, c) for i, r in enumerate(red) for c, y in r.after.items() if id(y) not in ids]
            if not blue:
                break
            _, i, c = min(blue)
            state = red[i].after[c]
            for r in red:
                if self._alike(r, state):
                    red[i].after[c] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
        self.states = red

    def logs(self, string: str) -> list[float]:
        """Log probability of each symbol, as if seen a tenth more, up to the first that never came there."""
        state, out, among = self.root, [], _LENGTHS
        for c in string:
            nxt = state.after.get(c)
            out.append(math.log(((nxt.seen if nxt else 0) + 0.1) / (state.seen + 0.1 * among)))
            if nxt is None:
                break
            state, among = nxt, _SYMBOLS
        return out

    def log(self, string: str) -> float:
        """Log probability of all symbols; beyond the first that never came there all are alike."""
        logs = self.logs(string)
        return sum(logs) - (len(string) - len(logs)) * math.log(_SYMBOLS)


class Format:
    """How credentials of one kind look: their automaton, and cases apart, as another case is the same format still."""

    def __init__(self, strings: Counter):
        self.automaton, self.cases = Automaton(Counter({s[1:]: n for s, n in strings.items()})), Counter()
        for s, n in strings.items():
            self.cases[s[0]] += n

    def logs(self, string: str) -> list[float]:
        return [math.log((self.cases[string[0]] + 0.1) / (self.cases.total() + 0.1 * _CASES)), *self.automaton.logs(string[1:])]


def transitions(string: str) -> list[tuple[str, str]]:
    """Pairs (before, symbol) of a token's symbols; case and length stand alone, and count as one to what follows."""
    return [("case", string[0]), ("length", string[1]), *zip("#" + string[2:], string[2:])]


@dataclass
class Model:
    """Formats by kind, and pairs of symbols in all tokens; verdicts are remembered, of so many tokens at most as fit a task."""

    formats: dict[str, Format]
    pairs: dict[str, Counter]
    least: float = GAIN
    known: dict[bytes, bool] = field(default_factory=dict)
    verdicts: dict[str, bool] = field(default_factory=dict)

    def gain(self, string: str) -> float:
        """Nats by which the likeliest format exceeds ordinary tokens, from which this one's own counts are taken off.

        What comes after a token has left a format speaks neither for nor against it.
        """
        logs = [f.logs(string) for f in self.formats.values()]
        most = max(map(len, logs), default=0)  # most tokens leave every format at once
        steps = transitions(string)
        own, befores = Counter(steps[:2] if most <= 2 else steps), Counter(before for before, _ in steps)
        plain = []
        for before, c in steps[:most]:
            seen = self.pairs.get(before, Counter())
            among = _CASES if before == "case" else _LENGTHS if before == "length" else _SYMBOLS
            plain.append(math.log((max(0, seen[c] - own[before, c]) + 1) / (max(0, seen.total() - befores[before]) + among)))
        return max((sum(x - y for x, y in zip(f, plain)) for f in logs), default=-math.inf)

    def fits(self, token: bytes) -> bool:
        """Whether a token is likelier a credential, by the odds of least."""
        yes = self.known.get(token)
        if yes is None:
            if len(self.known) > 1 << 17:
                self.known.clear()
            string = symbols(token.decode())
            yes = self.verdicts.get(string)
            if yes is None:
                if len(self.verdicts) > 1 << 16:
                    self.verdicts.clear()
                yes = self.verdicts[string] = self.gain(string) >= self.least
            self.known[token] = yes
        return yes

    def added(self, found: Sequence[tuple[int, str]]) -> list[tuple[int, int, int]]:
        return [(start, 3, start + len(token)) for start, token in found if self.fits(token.encode())]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, int, int]]]:
        """Base spans of a text, and those that the method adds."""
        data, tokens = long_tokens(text)
        base = base_spans(text, data, tokens)
        return base, self.added(candidates(text, base)) if any(map(self.fits, tokens)) else []


def learn(docs: DataFrame, labelled: DataFrame | None = None) -> Model:
    """Formats of the labelled credentials of docs, and pairs of symbols in all other tokens.

    Labelled are the finds of the base patterns and, if given, the rows (kind, value)
    of labelled. Formats are learned from at most SAMPLE different credentials of
    each kind, those of the smallest hashes; pairs are counted over all candidates of
    all documents, as often as they stand there, and summed in each task first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pairs: Counter = Counter()
        labels: set[tuple[str, str]] = set()

        def folded() -> None:
            strings: Counter = Counter()
            for token, n in seen.items():
                strings[symbols(token.decode())] += n
            for string, n in strings.items():
                for pair in transitions(string):
                    pairs[pair] += n
            seen.clear()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["what", "a", "b", "n"])

        for b in batches:
            for text in b.column(0):
                text = text.as_py() or ""
                data, tokens = long_tokens(text)
                base = base_spans(text, data, tokens)
                labels.update((KINDS[k], value) for _, k, _, value in base)
                seen.update([t.encode() for _, t in candidates(text, base)] if base else tokens)
                if len(seen) > 1 << 17:
                    folded()
                if len(labels) > 1 << 14:
                    yield out([("label", kind, value, 1) for kind, value in labels])
                    labels.clear()
        folded()
        yield out([("label", kind, value, 1) for kind, value in labels] + [("pair", a, b, n) for (a, b), n in pairs.items()])

    found = written(docs.select("text").mapInArrow(run, "what string, a string, b string, n long"), "secrets")
    labels = found.where("what = 'label'").select(F.col("a").alias("kind"), F.col("b").alias("value"))
    if labelled is not None:
        labels = labels.unionByName(labelled.select("kind", "value").where("kind is not null and value is not null and value <> ''"))
    labels = written(labels.distinct(), "credentials")
    formats: dict[str, Format] = {}
    for kind in sorted(r.kind for r in labels.select("kind").distinct().collect()):  # kinds are named by hand
        sample = labels.where(F.col("kind") == kind).select("value").orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
        formats[kind] = Format(Counter(symbols(r.value) for r in sample.collect()))
    pairs: dict[str, Counter] = defaultdict(Counter)
    for r in found.where("what = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # symbols are few
        pairs[r.a][r.b] = r.n
    return Model(formats, dict(pairs))


def joined(spans: Sequence[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end, *_ in sorted(s[:3] for s in spans))


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Secrets in each row of docs: counts, a digest of the base spans, and all spans.

    Spans are in code points of the whole text, end exclusive. A null text has
    none; repeated rows give repeated rows; extra columns aren't read. With no
    labelled credential anywhere, nothing is learned and only base spans are found.
    Texts are read twice, to learn and to score, and never shuffled; a very long one
    is held whole in its task. labelled: known credentials (kind, value) besides
    those that the base patterns find.
    """
    with scratch(docs.sparkSession):
        model = learn(docs, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            rows = []
            for text in b.column(1):
                text = text.as_py() or ""
                base, added = model.spans(text)
                spans = [s[:3] for s in base]
                kinds = Counter(k for _, k, _ in spans)
                every = spans + added
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(joined(spans).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[SECRET]", labelled: DataFrame | None = None) -> DataFrame:
    """docs with each secret of its texts replaced by mask; same columns, all rows kept.

    Of an assignment only the credential goes, not its name. Overlapping spans
    become one. n_chars, where there is such a column, follows the new text.
    A null text stays null, an empty one empty; repeated rows stay repeated.
    """
    with scratch(docs.sparkSession):
        model = learn(docs, labelled)
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts, lengths = [], []
            for text in b.column(at):
                text = text.as_py()
                if text:
                    base, added = model.spans(text)
                    spans = [(e - len(v) if k == 0 else s, e) for s, k, e, v in base] + [(s, e) for s, _, e in added]
                    out, done = [], 0
                    for start, end in sorted(spans):
                        if end <= done:
                            continue
                        if start >= done:
                            out += [text[done:start], mask]
                        done = end
                    text = "".join(out) + text[done:]
                texts.append(text)
                lengths.append(None if text is None else len(text))
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            if types.get("n_chars") in ("bigint", "int"):
                n = b.schema.get_field_index("n_chars")
                b = b.set_column(n, b.schema.field(n), pa.array(lengths, b.schema.field(n).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
