"""Personal data: base patterns and a linear-chain conditional random field (operator 9).

Base spans are leftmost, non-overlapping matches per kind with a check each
(octets of an ip, digits and Luhn sum of a card, digits of a phone number); a
match that fails its check is dropped.  They always stay.

The field adds what the patterns cannot spell out: numbers without a plus sign,
national ones too, addresses written with "at" and "dot", in brackets or plain,
spaced forms.  It labels
tokens B, I or O for each kind from word-shape features (shape of the token and
its neighbours, known context words, digits and place in the surrounding run of
digits).  It is trained from a small labelled table (texts with spans, at most
``MAX_LABELLED`` rows; :func:`labelled_table` writes one from templates) and
decoded by Viterbi in numpy, many sequences at a time.  A sequence is the text
within ``REACH`` characters of a digit, an ``@``, a bracketed "at" or a plain one
whose next word a "dot" follows, cut at white space; elsewhere a text holds nothing that a label could begin with.  An
added span must pass the check of its kind in normalised form and must not touch
a base span or another added one.

Whole texts are searched, in Arrow batches without a shuffle; every scan is
linear in the length of the text.

Defined cases: a null or empty text has no spans; offsets are code points, the
end exclusive; repeated rows get the same spans; other columns are kept.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.session import ship_package

KINDS = ("email", "ip", "card", "phone")
MAX_LABELLED = 20_000
REACH = 48
#: Texts of the labelled table in which a feature occurs at least.
SEEN = 3

Span = tuple[int, int]

# ---------------------------------------------------------------- base patterns

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# matches end where a run of digits ends, so one can only begin where a run begins
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in reversed(digits)]
    return (sum(odd[::2]) + sum(d * 2 - 9 * (d > 4) for d in odd[1::2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain and at > done and text[at - 1] in _LOCAL:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            done = domain.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) < 256 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# ---------------------------------------------------------------- tokens and features

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_TRIGGER = re.compile(r"[0-9@]+|[\[({] ?at ?[\])}]|(?<=[A-Za-z0-9._%+-]) at (?=[A-Za-z0-9-]++ dot [A-Za-z0-9])", re.IGNORECASE)
_RUN = re.compile(r"\+?\(?[0-9](?:[ ().\[\]/-]{0,3}[0-9])*+")


def sequences(text: str) -> list[Span]:
    """The stretches of the text that are decoded."""
    out: list[Span] = []
    for m in _TRIGGER.finditer(text):
        start, end = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return [_whole_words(text, a, b) for a, b in out]


def _whole_words(text: str, start: int, end: int) -> Span:
    """Leave out a word that the edge of the stretch cuts."""
    if start > 0 and not text[start - 1].isspace():
        while start < end and text[start] not in " \n\t\r" and not "0" <= text[start] <= "9" and text[start] != "@":
            start += 1
    if end < len(text) and not text[end].isspace():
        while end > start and text[end - 1] not in " \n\t\r" and not "0" <= text[end - 1] <= "9" and text[end - 1] != "@":
            end -= 1
    return start, end


def _shape(t: str) -> str:
    if "0" <= t[0] <= "9":
        return f"d{min(len(t), 7)}"
    if t[0].isalpha():
        return ("X" if t[0].isupper() else "x") + ("1" if len(t) == 1 else "2" if len(t) < 4 else "4")
    return t


def token_features(text: str, start: int, end: int) -> tuple[list[Span], list[list[str]]]:
    """Spans and feature names of the tokens of ``text[start:end]``."""
    spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
    words = [text[a:b] for a, b in spans]
    shapes = ["^", "^", *map(_shape, words), "$", "$"]
    runs = [(m.start(), m.end(), min(len(_digits(m.group())), 20)) for m in _RUN.finditer(text, start, end)]
    out, r = [], 0
    for i, ((a, b), w) in enumerate(zip(spans, words, strict=True)):
        s = shapes[i:i + 5]
        while r < len(runs) and runs[r][1] <= a:
            r += 1
        run = "none"
        if r < len(runs) and runs[r][0] <= a:
            first, last = a == runs[r][0], b >= runs[r][1]
            run = f"{runs[r][2]}{'f' if first else ''}{'l' if last else ''}"
        glued = ("l" if i and spans[i - 1][1] == a else "") + ("r" if i + 1 < len(spans) and spans[i + 1][0] == b else "")
        f = [f"s={s[2]}", f"s-={s[1]}|{s[2]}", f"s+={s[2]}|{s[3]}", f"s--={s[0]}|{s[1]}|{s[2]}", f"s++={s[2]}|{s[3]}|{s[4]}",
             f"run={run}", f"run={run}|{s[2]}", f"g={glued}|{s[2]}"]
        if w[0] == "0":
            f.append(f"0|{s[2]}|{s[3]}")
        for k, name in ((-2, "w--"), (-1, "w-"), (0, "w"), (1, "w+"), (2, "w++")):
            if 0 <= i + k < len(words) and words[i + k][0].isalpha():
                f.append(f"{name}={words[i + k].lower()}")
        out.append(f)
    return spans, out


# ---------------------------------------------------------------- the field

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_OF = {x: i for i, x in enumerate(LABELS)}
#: I follows only B or I of its kind.
_ALLOWED = np.array([[not b.startswith("I") or a[1:] == b[1:] and a != "O" for b in LABELS] for a in LABELS])
_FIRST = np.array([not x.startswith("I") for x in LABELS])
_NEVER = -1e4


#: Features whose scores are looked up at once.
_SCORED = 1 << 18


@dataclass
class Field:
    names: dict[str, int]
    emission: np.ndarray  # features x labels; the last row stands for padding and unknown features
    transition: np.ndarray

    def ids(self, features: Sequence[Sequence[str]]) -> list[list[int]]:
        get = self.names.get
        return [[k for f in fs if (k := get(f)) is not None] for fs in features]

    def scores(self, batch: Sequence[Sequence[Sequence[int]]]) -> np.ndarray:
        """Padded emission scores (sequences x longest x labels), a slice of the time axis at once."""
        x = pack(batch, len(self.emission) - 1)
        out = np.empty((*x.shape[:2], self.emission.shape[1]))
        step = max(_SCORED // max(x.shape[0] * x.shape[2], 1), 1)
        for t in range(0, x.shape[1], step):
            out[:, t:t + step] = self.emission[x[:, t:t + step]].sum(axis=2)
        return out

    def decode(self, batch: Sequence[Sequence[Sequence[int]]]) -> list[np.ndarray]:
        """The best labels of each sequence: Viterbi over all of them at once."""
        lengths = np.array([len(s) for s in batch])
        if not len(lengths) or not lengths.max():
            return [np.zeros(0, dtype=int) for _ in batch]
        e = self.scores(batch)
        trans = np.where(_ALLOWED, self.transition, _NEVER)
        best = e[:, 0] + np.where(_FIRST, 0, _NEVER)
        back = np.zeros(e.shape, dtype=np.int8)
        for t in range(1, e.shape[1]):
            total = best[:, :, None] + trans
            back[:, t] = total.argmax(axis=1)
            best = np.where((t < lengths)[:, None], total.max(axis=1) + e[:, t], best)
        out = np.zeros(e.shape[:2], dtype=np.int64)
        at = best.argmax(axis=1)
        rows = np.arange(len(batch))
        for t in range(e.shape[1] - 1, -1, -1):
            inside = t < lengths
            out[inside, t] = at[inside]
            at = np.where(inside & (t > 0), back[rows, t, at], at)
        return [out[i, :n] for i, n in enumerate(lengths)]


def pack(batch: Sequence[Sequence[Sequence[int]]], padding: int) -> np.ndarray:
    long, wide = max(map(len, batch)), max((len(t) for s in batch for t in s), default=1)
    out = np.full((len(batch), long, max(wide, 1)), padding, dtype=np.int32)
    for i, s in enumerate(batch):
        for j, t in enumerate(s):
            out[i, j, :len(t)] = t
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: Iterable[tuple[str, Sequence[tuple[str, int, int]]]], rounds: int = 80, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam steps; ``table``: texts with spans (kind, start, end)."""
    table = list(table)
    if len(table) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    texts, gold = [], []
    for text, spans in table:
        for a, b in sequences(text):
            tokens, features = token_features(text, a, b)
            y = [0] * len(tokens)
            for kind, s, e in spans:
                inside = [i for i, (x, z) in enumerate(tokens) if x >= s and z <= e]
                for n, i in enumerate(inside):
                    y[i] = _OF[f"{'I' if n else 'B'}-{kind}"]
            if tokens:
                texts.append(features)
                gold.append(y)
    often = Counter(f for s in texts for f in {f for t in s for f in t})
    names = {f: i for i, f in enumerate(f for f, k in often.items() if k >= SEEN)}
    field = Field(names, np.zeros((len(names) + 1, len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
    if not texts:
        return field
    x = pack([field.ids(s) for s in texts], len(names))
    n, long = x.shape[:2]
    lengths = np.array([len(y) for y in gold])
    inside = np.arange(long) < lengths[:, None]
    y = np.zeros((n, long), dtype=int)
    for i, labels in enumerate(gold):
        y[i, :len(labels)] = labels
    pairs = inside[:, 1:]
    seen_e = np.zeros_like(field.emission)
    np.add.at(seen_e, (x[inside], y[inside][:, None]), 1.0)
    seen_t = np.zeros_like(field.transition)
    np.add.at(seen_t, (y[:, :-1][pairs], y[:, 1:][pairs]), 1.0)
    flat = x[inside]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.emission, field.transition)]
    for step in range(1, rounds + 1):
        e = field.emission[x].sum(axis=2)
        trans = np.where(_ALLOWED, field.transition, _NEVER)
        forward = np.zeros_like(e)
        forward[:, 0] = e[:, 0] + np.where(_FIRST, 0, _NEVER)
        for t in range(1, long):
            nxt = _log_sum(forward[:, t - 1, :, None] + trans, 1) + e[:, t]
            forward[:, t] = np.where(inside[:, t, None], nxt, forward[:, t - 1])
        backward = np.zeros_like(e)
        for t in range(long - 2, -1, -1):
            nxt = _log_sum(trans + (e[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(inside[:, t + 1, None], nxt, 0)
        total = _log_sum(forward[:, -1], 1)
        p = np.exp(forward + backward - total[:, None, None])
        chances = np.repeat(p[inside], flat.shape[1], axis=0)
        want_e = np.stack([np.bincount(flat.ravel(), c, minlength=len(names) + 1) for c in chances.T], axis=1)
        joint = np.exp(forward[:, :-1, :, None] + trans + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        want_t = (joint * pairs[:, :, None, None]).sum(axis=(0, 1))
        for w, g, (m, v) in ((field.emission, (seen_e - want_e) / n, moments[0]), (field.transition, (seen_t - want_t) / n, moments[1])):
            g = g - ridge * w
            if w is field.emission:
                g[-1] = 0  # padding has no weight
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return field


# ---------------------------------------------------------------- the labelled table

# Carriers of the templates, {} is where the value stands.
_CARRIERS = {
    "phone": ["call {} today", "phone: {}", "Tel. {} or write", "the number {} is mine", "fax {}", "Telefon {} oder", "mobile {} .",
              "llame al {} ahora", "appelez le {} vite", "reach me on {}, please", "{} works too"],
    "email": ["write to {} today", "mail: {}", "contact {} for more", "e-mail {}", "schreiben Sie an {} bitte", "send it to {}, please"],
    "ip": ["the host {} is down", "server {} answered", "IP {}", "from {} to here", "ping {} again"],
    "card": ["card {} expires soon", "Visa {}", "pay with {} now", "credit card: {}", "charged {} twice"],
}
_PLAIN = ["License, Version 2.0.", "CC BY-NC 4.0.", "version 3.", "on 2021-03-14 we met", "on 14.03.2021 we met", "at 12:30:45 sharp", "costs 1,234.56 in all",
          "costs $ 19.99 only", "pages 123-145 of it", "from 1999-2004 on", "ISBN 978-3-16-148410-0 in print", "order #4711-0815 shipped",
          "chapter 3.2.1 says", "room 101 (floor 2)", "about 3 000 000 people", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" here",
          "in 2019, 2020, 2021 and 2022", "a ratio of 16:9 or 4:3", "sections 12 13 14 15 16 17", "it was 20 (or 30) of 1000", "see [1] [2] [3]",
          "twitter @someone said", "meet (at) noon", "5 x 10 x 15 cm", "zip 90210-1234 there", "9807915762804491 units", "vol. 12 no. 345 pp. 678-901",
          "look at that dot over there", "aimed at one dot on it", "at every dot we stop", "years 2019 2020 2021 there", "a sum of 1 234 567 890 in all",
          "1,234,567,890 of them", "0.123456789 of it", "id 0123456789 there", "serial 1234567890 here", "on 2021-03-14 12:30:45 we met", "stamp 20210314 123045 there",
          "rows 100 200 300 400 of it", "1999-2004 and 2005-2009", "from 1914-1918 1939-1945", "123.456.789 euros", "scores 21-19 18-21 21-17", "2 x 300 400 5000 mm",
          "part 123-456-78 is sold out", "3.14159265358979 or so"]


def labelled_table(rows: int = 900, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table: carriers with a value of each kind, in forms with and without the base
    patterns, and plain texts with numbers."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))

    def card() -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return r.choice([d, *[s.join(d[i:i + 4] for i in range(0, 16, 4)) for s in (" ", "-", ".", "  ", " - ", "/")]])

    def phone() -> str:
        a, b, c = r.choice("23456789") + num(2), num(3), num(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"({a}) {b}.{c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}",
                         f"+{num(2)} {num(3)} {num(7)}", f"00{num(2)} {num(3)} {num(7)}", f"+1/{a}/{b}/{c}", f"({a})/{b}-{c}",
                         *[s.join((a, b, c)) for s in ("-", ".", " ")],
                         *[f"0{a}{s}{num(n)}" for s, n in ((" ", r.randint(6, 8)), ("/", r.randint(6, 8)), ("-", r.randint(6, 8)), (" ", 8))],
                         " ".join((f"0{a}", b, c)), " ".join((f"0{a[:2]}", num(4), num(4))), " ".join((f"0{a[0]}", num(2), num(2), num(2), num(2)))])

    def ip() -> str:
        o = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice([".", ".", "[.]", " . ", "(.)"]).join(o)

    def email() -> str:
        at, dot = r.choice([("@", "."), ("@", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("(at)", "."), (" @ ", "."),
                            (" at ", " dot "), (" at ", " dot ")])
        return f"{name()}{r.choice(['', '.' + name(), num(2)])}{at}{name()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"

    value = {"phone": phone, "email": email, "ip": ip, "card": card}
    out = []
    for i in range(rows):
        lead = " ".join(name() for _ in range(r.randint(0, 3)))
        lead = lead and lead + " "
        if i % 3 == 0:
            out.append((lead + r.choice(_PLAIN), []))
            continue
        kind = r.choice(KINDS)
        before, after = r.choice(_CARRIERS[kind] + ["{}", f"{name()} {{}} {name()}"]).split("{}")
        v = value[kind]()
        at = len(lead) + len(before)
        out.append((lead + before + v + after, [(kind, at, at + len(v))]))
    return out


# ---------------------------------------------------------------- spans of a batch of texts

# a plain "at" is one only before a word and a plain "dot"
_UNDO = [(re.compile(r"\s*[\[({]\s*at\s*[\])}]\s*|\s+@\s+|\s+at\s+(?=[A-Za-z0-9-]++\s+dot\s)", re.IGNORECASE), "@"),
         (re.compile(r"\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+", re.IGNORECASE), ".")]
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@" + _DOMAIN.pattern)
_SPREAD_IP = re.compile(r"\s*[\[(]?\s*\.\s*[\])]?\s*")
_PHONE_FORM = re.compile(r"[+(]?[0-9][0-9 ()./-]*[0-9]")


def passes(kind: str, value: str) -> bool:
    """The check of an added span."""
    d = _digits(value)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[^\d ./-]", value)
    if kind == "phone":
        return 9 <= len(d) <= 15 and bool(_PHONE_FORM.fullmatch(value))
    if kind == "ip":
        flat = _SPREAD_IP.sub(".", value)
        return bool(re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", flat)) and all(int(p) < 256 for p in flat.split("."))
    for pattern, to in _UNDO:
        value = pattern.sub(to, value)
    return bool(_EMAIL.fullmatch(value))


def find_spans(texts: Sequence[str], field: Field, together: int = 512) -> list[list[tuple[str, int, int, bool]]]:
    """Spans (kind, start, end, is base) of each text, by kind and start."""
    based = [base_spans(t) for t in texts]
    jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in sequences(t)]
    jobs.sort(key=lambda j: j[2] - j[1])
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(jobs):
        # sequences of like length share a batch; a long one shares it with fewer
        size = max(1, min(together, 65_536 // max(1, jobs[min(at + together, len(jobs)) - 1][2] - jobs[at][1])))
        part, at = jobs[at:at + size], at + size
        tokens, ids = [], []
        for i, a, b in part:
            spans, features = token_features(texts[i], a, b)
            tokens.append(spans)
            ids.append(field.ids(features))
        for (i, _, _), spans, labels in zip(part, tokens, field.decode(ids), strict=True):
            k = 0
            while k < len(labels):
                if not labels[k]:
                    k += 1
                    continue
                first, kind = k, (labels[k] - 1) // 2
                k += 1
                while k < len(labels) and labels[k] == 2 * kind + 2:
                    k += 1
                added[i].append((KINDS[kind], spans[first][0], spans[k - 1][1]))
    out = []
    for text, base, more in zip(texts, based, added, strict=True):
        taken = sorted(s for spans in base.values() for s in spans)
        found = [(kind, a, b, True) for kind in KINDS for a, b in base[kind]]
        for kind, a, b in sorted(more, key=lambda s: s[1:]):
            edges = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            if edges and not any(x < b and a < y for x, y in taken) and passes(kind, text[a:b]):
                taken.append((a, b))
                found.append((kind, a, b, False))
        out.append(sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


# ---------------------------------------------------------------- Spark

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def with_spans(docs: DataFrame, table: Iterable[tuple[str, Sequence[tuple[str, int, int]]]] | None = None, text: str = "text",
               out: str = "spans") -> DataFrame:
    """Adds the spans of every whole text; ``table``: the labelled table to train from."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled_table() if table is None else table))

    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = shared.value
        for texts in parts:
            found: list = []
            for at in range(0, len(texts), 256):
                found += find_spans([t or "" for t in texts.iloc[at:at + 256]], field)
            yield pd.Series([[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in f] for f in found], dtype="object")

    spans.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, F.pandas_udf(spans, SPANS)(F.col(text)))


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets (a span inside another goes with it)."""
    flat = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    empty = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    body = F.coalesce(F.col(text), F.lit(""))

    def add(acc: Column, s: Column) -> Column:
        cut = F.concat(acc["t"], F.substr(body, acc["at"] + 1, s["a"] - acc["at"]), F.lit("["), s["k"], F.lit("]"))
        return F.when(s["a"] >= acc["at"], F.struct(cut.alias("t"), s["b"].alias("at"))).otherwise(
            F.struct(acc["t"].alias("t"), F.greatest(acc["at"], s["b"]).alias("at")))

    made = F.aggregate(flat, empty, add, lambda acc: F.concat(acc["t"], F.substr(body, acc["at"] + 1, F.char_length(body))))
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), made))
