"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

Base spans come from the four patterns (email, ip, card, phone) with their checks; they always stay. The field labels tokens (letter runs, digit
runs, single signs) as outside, or begin / inside of one of the kinds. Features are shapes: class and length of the token, its neighbours' classes,
signs, whether white space stands between, and a few cue words. Only a stretch of words that holds a digit, an at sign or a plus sign, and its direct
neighbours, can hold an entity; every other token is fixed as outside, so the chain falls into short parts that are decoded apart, many at a time,
by Viterbi in numpy. A decoded span is added where it overlaps no base span and holds what its kind needs (an at sign, four numbers, enough
digits): a number that failed a base check on its own is not brought back as that kind.

The field is trained on a small labelled table: TRAINING, sentences built by a rule from the fixed parts below, with personal data written in
and around the forms of the patterns, and look-alikes (dates, prices, versions, sums) that are none. Training is gradient ascent on the
penalised likelihood by forward-backward, on the driver; the table and the weights do not grow with the corpus.

A null text is empty and has no spans. Repeated rows and null ids are handled row by row; an empty table gives no rows. ``redact`` keeps all
columns; ``find`` leaves further columns out. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm.common import slices, table, texts

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
LOCAL, DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
MAX_BATCH = 4096


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns by kind, then start; every pattern in time linear in the text."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        # The local part is the whole run of its characters before the sign, after the last match.
        start = at
        while start > done and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# --- tokens and features -------------------------------------------------------------------------------------------------------

# A word with a digit, an at sign or a plus sign.
MARKED = re.compile(r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
WORD_BEFORE, WORD_AFTER = re.compile(r"(\S+)\s*$"), re.compile(r"\s*(\S+)")
CUES = ["mail", "email", "phone", "tel", "telephone", "call", "fax", "mobile", "card", "visa", "ip", "address", "server", "host", "at", "dot"]
FEATURES = 1 << 12
REACH = 60  # characters looked at for a neighbouring word


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of text made of marked words that follow each other with white space only between them."""
    start = end = -1
    for m in MARKED.finditer(text):
        if start >= 0 and text[end : m.start()].isspace() and m.start() - end <= 2:
            end = m.end()
        else:
            if start >= 0:
                yield start, end
            start, end = m.span()
    if start >= 0:
        yield start, end


def shape(token: str) -> str:
    if token[0].isascii() and token[0].isdigit():
        return f"d{len(token) if len(token) < 7 else 7 if len(token) < 13 else 13 if len(token) < 20 else 20}"
    if token.isalpha():
        return ("X" if token[0].isupper() else "x") + str(min(len(token), 4))
    return token


@lru_cache(200_000)
def _code(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % FEATURES


def features(tokens: list[tuple[str, int, int]], before: str, after: str) -> list[list[int]]:
    """Feature numbers of each token; ``before`` and ``after`` are the words around the stretch."""
    shapes = ["^^", "^", *[shape(t) for t, _, _ in tokens], "$", "$$"]
    gaps = ["_"] + ["_" if a[2] < b[1] else "" for a, b in zip(tokens, tokens[1:])] + ["_"]
    words = [before.lower().strip(".,:;()")] + [t.lower() for t, _, _ in tokens] + [after.lower().strip(".,:;()")]
    digits = sum(len(t) for t, _, _ in tokens if t[0].isdigit())
    out = []
    for i, (t, _, _) in enumerate(tokens):
        s = shapes[i : i + 5]
        names = ["bias", f"0{s[2]}", f"-{s[1]}{gaps[i]}", f"+{gaps[i + 1]}{s[3]}", f"-0{s[1]}{gaps[i]}{s[2]}", f"0+{s[2]}{gaps[i + 1]}{s[3]}", f"-0+{s[1]}{gaps[i]}{s[2]}{gaps[i + 1]}{s[3]}", f"--{s[0]}{s[1]}", f"++{s[3]}{s[4]}", f"n{min(digits, 20)}{s[2][0]}"]
        names += [f"c{w}" for w in (words[i], words[i + 2]) if w in CUES] + ([f"w{t.lower()}"] if t.lower() in CUES else [])
        out.append([_code(n) for n in names])
    return out


# --- the field -------------------------------------------------------------------------------------------------------------------

FORBIDDEN = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in LABELS] for a in LABELS])
START_FORBIDDEN = np.array([b.startswith("I-") for b in LABELS])


class Field:
    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, np.where(FORBIDDEN, -1e9, move), np.where(START_FORBIDDEN, -1e9, start)

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        flat = np.concatenate([np.asarray(f) for f in feats])
        at = np.concatenate([[0], np.cumsum([len(f) for f in feats])[:-1]])
        return np.add.reduceat(self.emit[flat], at, axis=0)

    def decode(self, parts: list[list[list[int]]]) -> list[np.ndarray]:
        """Best label path of every part: parts of like length are stepped through together."""
        out: list = [None] * len(parts)
        order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
        k = 0
        while k < len(order):
            longest, stop = len(parts[order[k]]), k + 1
            while stop < len(order) and stop - k < MAX_BATCH and len(parts[order[stop]]) == longest:
                stop += 1
            group = order[k:stop]
            score = self.scores([f for g in group for f in parts[g]]).reshape(len(group), longest, -1)
            best = self.start + score[:, 0]
            back = np.zeros((len(group), longest, len(LABELS)), np.int8)
            for t in range(1, longest):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(1)
                best = step.max(1) + score[:, t]
            path = np.zeros((len(group), longest), np.int8)
            path[:, -1] = best.argmax(1)
            for t in range(longest - 1, 0, -1):
                path[:, t - 1] = back[np.arange(len(group)), t, path[:, t]]
            for g, p in zip(group, path):
                out[g] = p
            k = stop
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(parts: list[tuple[list[list[int]], np.ndarray]], steps: int = 40, rate: float = 0.3, penalty: float = 0.02) -> Field:
    """Field fitted by penalised likelihood with adaptive gradient steps."""
    n = len(LABELS)
    emit, move, start = np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros(n)
    squares = [np.full(x.shape, 1e-8) for x in (emit, move, start)]
    for _ in range(steps):
        grads = [-penalty * emit, -penalty * move, -penalty * start]
        field = Field(emit, move, start)
        for feats, gold in parts:
            s = field.scores(feats)
            length = len(s)
            alpha, beta = np.zeros((length, n)), np.zeros((length, n))
            alpha[0] = field.start + s[0]
            for t in range(1, length):
                alpha[t] = _log_sum(alpha[t - 1][:, None] + field.move, 0) + s[t]
            for t in range(length - 2, -1, -1):
                beta[t] = _log_sum(field.move + s[t + 1] + beta[t + 1], 1)
            total = _log_sum(alpha[-1], 0)
            want = -np.exp(alpha + beta - total)
            want[np.arange(length), gold] += 1
            flat = np.concatenate([np.asarray(f) for f in feats])
            np.add.at(grads[0], flat, np.repeat(want, [len(f) for f in feats], axis=0))
            for t in range(1, length):
                pair = -np.exp(alpha[t - 1][:, None] + field.move + s[t] + beta[t] - total)
                pair[gold[t - 1], gold[t]] += 1
                grads[1] += pair
            grads[2] += want[0]
        for x, g, q in zip((emit, move, start), grads, squares):
            q += g * g
            x += rate * g / np.sqrt(q)
    return Field(emit, move, start)


# Fixed parts of the labelled table. A kind's forms are written with 9 for any digit; CARD stands for a number that passes the check.
FORMS = {
    "email": ["jo.99@mail9.example.com", "ann_lee@example.org", "x9@sub.example.net", "first.last+tag@example.co", "info @ example.org", "sales@ example.com"],
    "ip": ["99.99.99.99", "199.99.9.9", "10.9.99.199", "9.9.9.9"],
    "card": ["CARD", "CARD4"],
    "phone": ["+99 999 9999999", "+9 (999) 999-9999", "+99.99.999.9999", "+99-999-999999", "(999) 999-9999", "0999 999 9999", "00 99 999 9999999"],
}
NONE = ["9", "99", "9999", "9.9", "9.99", "v9.9.9", "9999-99-99", "99/99/9999", "99:99", "$99.99", "9,999,999", "99%", "A9", "9th", "99 + 99", "C++", "@name", "a@b", "9.9.9", "9999 9999", "99-99", "x9", "9+9=99", "#9999", "9999999", "99999 999", "+9", "+99%", "999.999.999.999", "9999999999", "9 9 9 9 9 9", "99 999 99"]
FRAMES = ["{}", "Write to {} today.", "the {} and", "mail: {}", "call {} now", "card {}", "server {}, up", "({})", "{}.", "in {} it was", "tel. {};", "host {} or", "by {} 46636226175123 and", "a 83 {} it"]


def _digits(form: str, seed: int) -> str:
    rng = np.random.default_rng(seed)
    if form.startswith("CARD"):
        body = "".join(str(d) for d in rng.integers(0, 10, 15))
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return number if form == "CARD" else " ".join(number[k : k + 4] for k in range(0, 16, 4))
    limited = re.fullmatch(r"[0-9.]+", form) and form.count(".") == 3 and "999" not in form
    return re.sub("9", lambda _: str(rng.integers(1, 3 if limited else 10)), form)


def training_table() -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences and their spans: every form in some frames."""
    out = []
    cases = [(kind, form) for kind, forms in FORMS.items() for form in forms] + [("", form) for form in NONE]
    for k, (kind, form) in enumerate(cases):
        for j in range(5):
            frame = FRAMES[(k * 5 + j * 3) % len(FRAMES)]
            body = _digits(form, 97 * k + j)
            at = frame.index("{}")
            out.append((frame.format(body), [(kind, at, at + len(body))] if kind else []))
    return out


def parts_of(text: str) -> Iterator[tuple[list[tuple[str, int, int]], list[list[int]]]]:
    for start, end in stretches(text):
        before, after = WORD_BEFORE.search(text[max(0, start - REACH) : start]), WORD_AFTER.match(text[end : end + REACH])
        # An address may be spelled over its neighbours, so their words belong to the part.
        a = max(0, start - REACH) + before.start(1) if before else start
        b = end + after.end(1) if after else end
        tokens = [(m[0], m.start() + a, m.end() + a) for m in TOKEN.finditer(text[a:b])]
        if tokens:
            yield tokens, features(tokens, "", "")


@lru_cache(1)
def trained() -> Field:
    parts = []
    for text, spans in training_table():
        for tokens, feats in parts_of(text):
            gold = []
            for _, a, b in tokens:
                kind = next(((k, s) for k, s, e in spans if s <= a and b <= e), None)
                gold.append(0 if kind is None else LABELS.index(("B-" if a == kind[1] else "I-") + kind[0]))
            parts.append((feats, np.array(gold)))
    return train(parts)


def valid(kind: str, body: str) -> bool:
    """What a decoded span of the kind has to hold."""
    digits = NOT_DIGIT.sub("", body)
    if kind == "email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]+\s?@\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", body) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(?:\s?\.\s?[0-9]{1,3}){3}", body) is not None and all(int(p) <= 255 for p in re.findall("[0-9]+", body))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9][0-9 .-]*", body) is not None
    return 9 <= len(digits) <= 15 and len(re.findall(r"[0-9]+", body)) >= 3 and re.fullmatch(r"\+?[0-9(][0-9 ().-]*[0-9]", body) is not None and re.fullmatch(r"[0-9]+(?:[.-][0-9]+)*", body) is None


def all_spans(batch: list[str], field: Field) -> list[tuple[list, list]]:
    """Base spans and all spans of each text."""
    parts, owner = [], []
    for k, text in enumerate(batch):
        for part in parts_of(text):
            parts.append(part)
            owner.append(k)
    bases = [base_spans(t) for t in batch]
    out = [list(b) for b in bases]
    for k, (tokens, _), path in zip(owner, parts, field.decode([p[1] for p in parts])):
        i = 0
        while i < len(path):
            if path[i] % 2 == 1:
                j = i + 1
                while j < len(path) and path[j] == path[i] + 1:
                    j += 1
                kind, a, b = KINDS[path[i] // 2], tokens[i][1], tokens[j - 1][2]
                if all(b <= s or e <= a for _, s, e in out[k]) and valid(kind, batch[k][a:b]):
                    out[k].append((kind, a, b))
                i = j
            else:
                i += 1
    return [(b, sorted(s, key=lambda x: (KINDS.index(x[0]), x[1]))) for b, s in zip(bases, out)]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """Counts per kind and digest of the base spans, all spans, and how many of them the field added."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = all_spans([t or "" for t in texts(batch)], shared.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array([written(s) for _, s in found], pa.string()), pa.array([len(s) - len(base) for base, s in found], pa.int64())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns
    inner = docs.toDF(*["text" if c == "text" else f"c{k}" for k, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bodies = texts(batch)
            out = []
            for text, (_, spans) in zip(bodies, all_spans([t or "" for t in bodies], shared.value)):
                pieces, done = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= done:
                        pieces += [text[done:a], f"<{kind}>"]
                    done = max(done, b)
                out.append(text if not spans else "".join([*pieces, text[done:]]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return inner.mapInArrow(run, inner.schema).toDF(*names)


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    return find(table(spark, folder, "documents"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    del spark, folder
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
