"""Personal data: base patterns, and further spans found by weak supervision.

Base patterns always count. Looser candidates (obfuscated addresses, numbers without a country code, card-like numbers
that fail a check, addresses with blanks) are judged: regex, gazetteer and context labelers vote on every candidate,
base ones included; expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is
for each kind; and the resulting probabilities train a final span classifier, a logistic regression over hashed shape
and context features. A loose candidate that the classifier accepts is added.

Vote patterns are few (kinds times three to the power of labelers), so their counts come to the driver whatever the
corpus; the classifier is fitted on a bounded sample of candidates (SAMPLE).

Defined results: null and empty texts have no spans; rows with a null or repeated doc_id are scanned row by row; other
columns are ignored, whatever their names; an empty table gives no rows; with no candidates nothing is added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, prepare

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts at its run's first digit or nowhere; saying so keeps long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser candidates by kind.
LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])|(?<![0-9+])00[0-9](?: ?[0-9]){8,}+(?![0-9])")),
)
#: Words that name a kind, in the four languages of the corpus.
GAZETTEER = {
    "email": {"email", "mail", "mailto", "contact", "write", "courriel", "correo", "kontakt", "adresse"},
    "ip": {"ip", "host", "server", "address", "addr", "gateway", "client", "serveur", "servidor", "rechner"},
    "card": {"card", "visa", "mastercard", "credit", "payment", "carte", "tarjeta", "karte", "pan"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone", "téléphone", "teléfono", "telefon", "handy"},
}
#: Words and signs that speak against it when they stand right before a number.
AGAINST = ("version", "ver", "v", "#", "no", "nr", "$", "€", "=", "isbn", "id", "page", "=>", "section")
LABELERS = ("shape", "valid", "gazetteer", "context", "isolated")
NEAR = 48
FEATURES = 1 << 12
#: Candidates that the span classifier is fitted on at most.
SAMPLE = 20_000
#: How often at most one and the same example counts when the classifier is fitted, so that copies don't outvote the rest.
REPEATS = 20
THRESHOLD = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int, int]]:
    """The matches of EMAIL, from each @ outwards: linear in the text, whatever it holds."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        floor = m.end() if m else at + 1
        if m:
            out.append((start, 0, m.end()))
        at = text.find("@", floor)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order."""
    out = _emails(text)
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of loose candidates that no base span of any kind overlaps."""
    out = []
    for kind, pattern in LOOSE:
        out += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text)]
    kept, b = [], 0
    for a, k, e in sorted(out):
        while b < len(base) and base[b][2] <= a:
            b += 1
        if not any(s[0] < e and a < s[2] for s in base[b : b + 4]) and (not kept or kept[-1][2] <= a):
            kept.append((a, k, e))
    return kept


_WORD = re.compile(r"[^\W\d_]+|[#$€=>]+")


def votes(text: str, a: int, k: int, e: int) -> tuple[int, ...]:
    """What each labeler says of a candidate: 1 for, -1 against, 0 nothing."""
    own, before, after = text[a:e], text[max(0, a - NEAR) : a], text[e : e + NEAR]
    kind, d = KINDS[k], _digits(own)
    shape = 1 if (EMAIL, IP, CARD, PHONE)[k].fullmatch(own) else -1 if len(set(d)) == 1 and d else 0
    if kind == "card":
        valid = 1 if 14 <= len(d) <= 19 and luhn(d) else -1
    elif kind == "phone":
        valid = 1 if 10 <= len(d) <= 15 else -1
    elif kind == "ip":
        valid = 1 if ":" in own or all(int(p) <= 255 for p in own.split(".")) else -1
    else:
        valid = 1 if re.search(r"[A-Za-z]{2,}$", own) else -1
    words_before = [w.lower() for w in _WORD.findall(before)]
    near = {*words_before, *(w.lower() for w in _WORD.findall(after))}
    gazetteer = 1 if near & GAZETTEER[kind] else -1 if any(near & GAZETTEER[o] for o in KINDS if o != kind) else 0
    last = words_before[-1] if words_before else ""
    context = -1 if last in AGAINST else 1 if last in GAZETTEER[kind] else 0
    edges = text[a - 1 : a] + text[e : e + 1]
    isolated = -1 if any(c.isalnum() or c in "@/_" for c in edges) else 1
    return shape, valid, gazetteer, context, isolated


def code(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**j for j, x in enumerate(v))


def decode(c: int) -> tuple[int, ...]:
    return tuple(c // 3**j % 3 - 1 for j in range(len(LABELERS)))


def features(text: str, a: int, k: int, e: int) -> list[int]:
    """Hashed features of a candidate: its kind with its shape, its length, and words around it."""
    own = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "0", text[a:e]))
    before, after = _WORD.findall(text[max(0, a - NEAR) : a])[-2:], _WORD.findall(text[e : e + NEAR])[:2]
    named = [f"k{k}", f"s{k}{own[:24]}", f"l{k}{min(e - a, 40) // 4}", f"d{k}{len(_digits(own))}"]
    named += [f"b{k}{w.lower()}" for w in before] + [f"a{k}{w.lower()}" for w in after]
    named += [f"e{k}{'x' if c.isalnum() else c}{side}" for side, c in ((0, text[a - 1 : a]), (1, text[e : e + 1])) if c]
    return sorted({zlib.crc32(x.encode()) % FEATURES for x in named})


def find_candidates(docs: DataFrame, *kept: str) -> DataFrame:
    """kept columns of docs (text), and an array of candidates: kind, start, end, base, votes, features."""
    prepare(docs.sparkSession)
    item = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])

    def find(batches):
        for batch in batches:
            found = []
            for x in batch.column("text"):
                text = x.as_py() or ""
                base = base_spans(text)
                each = [(a, k, e, True) for a, k, e in base] + [(a, k, e, False) for a, k, e in loose_spans(text, base)]
                found.append([{"kind": k, "start": a, "end": e, "base": b, "votes": code(votes(text, a, k, e)), "features": features(text, a, k, e)} for a, k, e, b in sorted(each)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.list_(item))], [*kept, "candidates"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    read = [*kept] if "text" in kept else [*kept, "text"]
    return docs.select(*read).mapInArrow(find, f"{types}, candidates array<struct<kind:int,start:bigint,end:bigint,base:boolean,votes:int,features:array<int>>>")


def label_model(patterns: dict[tuple[int, int], int], rounds: int = 50) -> dict[tuple[int, int], float]:
    """P(personal data) for each (kind, vote pattern), by EM over their counts: labelers err independently of each other.

    Starts from the majority of votes and keeps a weak prior on every rate, so that rare kinds stay stable.
    """
    out = {}
    for kind in range(len(KINDS)):
        own = [(c, n) for (k, c), n in patterns.items() if k == kind]
        if not own:
            continue
        v = np.array([decode(c) for c, _ in own])
        n = np.array([n for _, n in own], float)
        p = 1 / (1 + np.exp(-1.5 * v.sum(1)))
        for _ in range(rounds):
            prior = (np.dot(n, p) + 1) / (n.sum() + 2)
            logit = np.full(len(n), np.log(prior / (1 - prior)))
            for j in range(v.shape[1]):
                for x in (-1, 0, 1):
                    hit = v[:, j] == x
                    # Rates start from what the vote means: for, nothing, against.
                    yes = (np.dot(n[hit], p[hit]) + (4, 3, 2)[1 - x]) / (np.dot(n, p) + 9)
                    no = (np.dot(n[hit], 1 - p[hit]) + (2, 3, 4)[1 - x]) / (np.dot(n, 1 - p) + 9)
                    logit[hit] += np.log(yes / no)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out |= {(kind, c): float(x) for (c, _), x in zip(own, p, strict=True)}
    return out


@dataclass
class Classifier:
    weights: np.ndarray
    bias: float

    def scores(self, found: list[list[int]]) -> np.ndarray:
        """Probabilities of many candidates at once; each has a feature at least."""
        if not found:
            return np.zeros(0)
        size = np.array([len(f) for f in found])
        total = np.add.reduceat(self.weights[np.concatenate(found)], np.cumsum(size) - size)
        return 1 / (1 + np.exp(-(total + self.bias)))


def train(items: list[tuple[list[int], float]], rounds: int = 60, rate: float = 2.0, decay: float = 1e-3) -> Classifier:
    """Logistic regression on hashed features with probabilities as targets."""
    weights, bias = np.zeros(FEATURES), 0.0
    if not items:
        return Classifier(weights, -30.0)
    row = np.repeat(np.arange(len(items)), [len(f) for f, _ in items])
    column = np.array([x for f, _ in items for x in f])
    target = np.array([p for _, p in items])
    seen = np.maximum(np.bincount(column, minlength=FEATURES), 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(row, weights[column], minlength=len(items)) + bias)))
        error = target - p
        weights += rate * (np.bincount(column, error[row], minlength=FEATURES) / seen / 8 - decay * weights)
        bias += rate * error.mean() / 8
    return Classifier(weights, bias)


def fit(found: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Label model and span classifier from candidates (find_candidates())."""
    each = found.select(F.inline("candidates"))
    counts = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    chance = label_model(counts)
    total = sum(counts.values())
    if total > sample:
        each = each.filter(F.pmod(F.xxhash64("kind", "start", "end", "features"), F.lit(1 << 30)) < int((1 << 30) * sample / total))
    rows = each.select("kind", "votes", "features").groupBy("kind", "votes", "features").agg(F.count("*").alias("n")).collect()
    items = [(r["features"], chance[r["kind"], r["votes"]]) for r in sorted(rows, key=lambda r: (r["kind"], r["votes"], r["features"])) for _ in range(min(r["n"], REPEATS))]
    return train(items)


def find_personal_data(docs: DataFrame, *kept: str) -> DataFrame:
    """kept columns of docs (text), and spans: an array of (kind number, start, end, base) in order."""
    found = cut(find_candidates(docs, *kept))
    model = fit(found)

    def judge(batches):
        for batch in batches:
            out = []
            cells = batch.column("candidates").to_pylist()
            good = iter((model.scores([c["features"] for cell in cells for c in cell if not c["base"]]) >= THRESHOLD).tolist())
            for cell in cells:
                out.append([{"kind": c["kind"], "start": c["start"], "end": c["end"], "base": c["base"]} for c in cell if c["base"] or next(good)])
            item = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.list_(item))], [*kept, "spans"])

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return found.mapInArrow(judge, f"{types}, spans array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str:
    """The text with spans (start, kind number, end) replaced by the names of their kinds; the wider of two stays."""
    text = text or ""
    out, at = [], 0
    for a, k, e in sorted(spans, key=lambda s: (s[0], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
            at = e
        elif e > at:  # what two kinds share goes with the first, the rest too
            at = e
    return "".join([*out, text[at:]])


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")

    def digest(batches):
        for batch in batches:
            counts, base, spans = [], [], []
            for cell in batch.column("spans").to_pylist():
                counts.append([sum(s["base"] and s["kind"] == k for s in cell) for k in range(len(KINDS))])
                text = lambda own: ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in own)
                base.append(hashlib.sha256(text([s for s in cell if s["base"]]).encode()).hexdigest())
                spans.append(text(cell))
            number = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(number[:, k]) for k in range(len(KINDS))), pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    id_type = got.schema["doc_id"].dataType.simpleString()
    return got.mapInArrow(digest, f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
