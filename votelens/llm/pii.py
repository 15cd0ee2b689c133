"""Personal data: known forms by pattern, others by a linear-chain conditional random field over word shapes.

Tokens are what stands between white space, without one trailing punctuation mark. A token's features are its shape (runs of
upper-case, lower-case and digit characters and of each mark; digit runs with their length), the shapes beside it, the
characters it holds, its word and the words before it, as far as the labelled table has them. The field is trained by gradient
ascent on the log likelihood (forward-backward), and lines are decoded by Viterbi in numpy batches. A line in which no token can
gain over the label "outside", whatever its neighbours' labels, needs no decoding: its best path is known.

The labelled table is small and part of this module (``LABELLED``); any other of the same form can be given.

Rows: a null text is empty and has no spans; repeated rows give equal rows; positions count code points, ends are exclusive."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votelens.llm.common import id_and_text, share, slices

#: Sentences with their personal data marked; the kind stands before the colon.
LABELLED = """
Call me at [phone:(377) 555-0271] after six.
You can reach her on [phone:555-0142] today.
My phone number is [phone:0171 555 3921] at home.
Telephone [phone:030 5550 1234] between nine and five.
Tel: [phone:020-7946-0018] or ask at the desk.
Fax [phone:(212) 555-0199] with the signed form.
Mobile [phone:06 12 34 56 78] works best.
Rufen Sie uns an unter [phone:0221 5550199] bitte.
Appelez le [phone:01 55 50 12 34] avant midi.
Llame al [phone:91 555 01 23] por favor.
Phone [phone:+1 (377) 555-0271] for the office.
Write to [email:anna.lee@mail7.example.com] soon.
The address is [email:j.smith@example.org] and nothing else.
Mail [email:sam at example dot com] for details.
Contact [email:kim (at) example.net] about it.
Send it to [email:lee@localhost] instead.
E-mail an [email:info@beispiel.de] senden.
Server [ip:10.0.12.7] was down.
Login from [ip:192.168.1.14] at night.
Host [ip:fe80:0:0:0:1a2b:3c4d:5e6f:7a8b] answered.
The client [ip:2001:db8:0:0:0:0:2:1] was blocked.
Card [card:4111 1111 1111 1111] was charged.
Credit card number [card:5500005555555559] on file.
Karte [card:4000-0012-3456-7899] ist gesperrt.
Visa [card:4012888888881881] expires soon.
His social security number is [ssn:078-05-1120] they say.
SSN [ssn:219-09-9999] was on the form.
Passport number [ssn:X12345678] was lost.
National id [ssn:12345678Z] belongs to him.
Account [iban:DE89 3704 0044 0532 0130 00] received it.
IBAN [iban:GB29NWBK60161331926819] please.
The meeting is on 2024-05-17 at 10:30 in room 12.
Version 1.2.3 came out in 2019, not 2018.
Section 4.5.6 has 12 pages and 3 tables.
It cost 1,250.00 and then 17.5 percent more.
Chapter 3, verses 16 to 18, year 1984.
Order 20391 was sent on 12/05/2023 with 3 boxes.
We saw 1200 people and 35 dogs in 1999.
The ratio was 3:1 at 20:45 on day 7.
Build 8841-2 passed 117 of 120 tests.
Licensed under the Apache License, Version 2.0.
Page 27 | 2015 | 48 | 3.75
Ofan$$$ the### and&&& tion%%% ing*** of the&&& nd,$$$ er.&&& Th,### that.
Onest*** tily&&& ntly$$$ he### whti,%%% for*** is&&& to%%% atrees$$$ bleh### Heth***
THE!! NDAR!! ERTION AND WE!! ARE HERE!! NOW, THEY SAY.
STHE, ONIN!! QUEA EL!! LOS ÉTAN MENTE!! ÜBER DER!! STAND, CI.
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and so on.
erti token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" elle que.
It was 7536784127813050 in all and 4845168114407329 before.
The sum 2390409500648960 stands beside 9890149938096989 here.
Licensed under CC BY-NC 4.0. All rights kept (c) 2020 A. Nte.
que | mente | osdo | bo | a | 12 | 3 | ñdoos.
<b>the</b> &amp; "and" 'of' (see there) [1] {x} ~ a/b c_d e=f
The cat sat on the mat and looked at the dog.
Der Hund und die Katze sind im Haus.
Le chat est sur la table avec nous.
El perro y el gato viven en la casa.
They write at home and call it a day.
He was at the office and reached the end.
"""
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
#: Label 0 is "outside"; neighbouring tokens of one kind are one span.
LABELS = ["outside", *KINDS]
BASE = ("email", "ip", "card", "phone")
PASSES, RATE, PENALTY = 300, 0.3, 0.02

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the known forms. Each search is linear in the text."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            for m in _IP.finditer(text, run.start(), run.end()):
                if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                    out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Character classes: 0 white space, 1 upper case, 2 lower case and all beyond ASCII, 3 digit, then one for each mark.
_MARKS = "@.-+()/:_,%|#$*&"
_CLASS = np.full(129, 4, np.uint8)  # the last for all beyond ASCII
_CLASS[128] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 5 + _i
_TRAILING = np.zeros(129, bool)
_TRAILING[[ord(c) for c in ".,;:!?\"'"]] = True
_FLAG = 1 << np.minimum(np.arange(32), 12)
_B = np.uint64(0x100000001B3)


def _reduced(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``codes`` that begins at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.r_[starts, len(codes)])
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max()), _B, np.uint64)], dtype=np.uint64)
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    h = np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * powers[place], starts)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@dataclass
class Tokens:
    start: np.ndarray  # in the joined texts
    end: np.ndarray
    line: np.ndarray  # number of the line, over all texts
    shape: np.ndarray
    word: np.ndarray
    flags: np.ndarray


def tokens(points: np.ndarray) -> Tokens:
    """Tokens of texts joined by line feeds, as code points."""
    narrow = np.minimum(points, 128)
    kind = _CLASS[narrow]
    blank = kind == 0
    ends = np.r_[blank[1:], True]
    before = np.r_[True, blank[:-1]]
    blank |= _TRAILING[narrow] & ends & ~before
    inside = np.flatnonzero(~blank)
    if not len(inside):
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    new = np.r_[True, np.diff(inside) > 1]
    first = np.flatnonzero(new)
    start, end = inside[first], inside[np.r_[first[1:], len(inside)] - 1] + 1
    k = kind[inside]
    run = np.flatnonzero(new | np.r_[True, k[1:] != k[:-1]])
    length = np.diff(np.r_[run, len(k)])
    size = np.where(k[run] == 3, np.minimum(length, 5) + (length > 8), 0)
    shape = _reduced(k[run].astype(np.uint64) * np.uint64(8) + size.astype(np.uint64), np.searchsorted(run, first))
    low = points[inside].copy()
    low[k == 1] += 32
    word = _reduced(low, first)
    flags = np.bitwise_or.reduceat(_FLAG[k], first)
    line = np.searchsorted(np.flatnonzero(points == 10), start)
    return Tokens(start, end, line, shape, word, flags)


def _feature_keys(t: Tokens) -> list[np.ndarray]:
    """One key for each feature of each token; beyond the line's ends the neighbour's key is a constant."""
    def moved(values: np.ndarray, by: int) -> np.ndarray:
        out = np.full(len(values), 0x5BD1E995, np.uint64)
        if len(values) > abs(by):
            a, b = (slice(-by, None), slice(None, by)) if by < 0 else (slice(None, -by), slice(by, None))
            out[a] = np.where(t.line[a] == t.line[b], values[b], out[a])
        return out

    flags = t.flags.astype(np.uint64)
    parts = [t.shape, moved(t.shape, -1), moved(t.shape, 1), flags, t.word, moved(t.word, -1), moved(t.word, -2)]
    return [(p ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i) for i, p in enumerate(parts)]


@dataclass
class Field:
    keys: np.ndarray  # known features, in order
    weights: np.ndarray  # of each known feature and label; the last row, for unknown ones, is zero
    moves: np.ndarray  # [from, to]
    begins: np.ndarray

    def ids(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def emissions(self, t: Tokens) -> np.ndarray:
        out = np.zeros((len(t.start), len(LABELS)), np.float32)
        for key in _feature_keys(t):
            i = self.ids(key)
            known = np.flatnonzero(i < len(self.keys))
            out[known] += self.weights[i[known]]
        return out

    def decode(self, t: Tokens) -> np.ndarray:
        """The label of each token on its line's best path."""
        labels = np.zeros(len(t.start), np.int64)
        if not len(labels):
            return labels
        e = self.emissions(t)
        # a label other than "outside" gains at most its emission and its best move in, and once the move back
        enter = np.maximum(self.moves.max(axis=0) - self.moves[0, 0], self.begins - self.begins[0])[1:]
        leave = max(float((self.moves[1:, 0] - self.moves[0, 0]).max()), 0)
        over = (e[:, 1:] + enter[None, :]).max(axis=1) - e[:, 0]
        first = np.flatnonzero(np.r_[True, t.line[1:] != t.line[:-1]])
        most = np.add.reduceat(np.maximum(over, 0), first) + leave  # that a stretch of other labels can gain in the line
        sure = over + np.repeat(most, np.diff(np.r_[first, len(labels)])) <= 0
        # stretches between tokens that are outside on any best path
        opens = np.zeros(len(labels), bool)
        opens[first] = True
        opens[1:] |= sure[:-1]
        opens &= ~sure
        begin = np.flatnonzero(opens)
        if not len(begin):
            return labels
        stops = np.flatnonzero(np.r_[sure[1:] | (t.line[1:] != t.line[:-1]), True] & ~sure) + 1
        hopeful = np.add.reduceat(np.where(sure, 0, over + leave > 0), begin) > 0
        begin, stops = begin[hopeful], stops[hopeful]
        order = np.argsort(stops - begin, kind="stable")
        begin, length = begin[order], (stops - begin)[order]
        inner = np.zeros(len(labels) + 1, bool)
        inner[:-1][1:] = t.line[1:] == t.line[:-1]
        after_cut, before_cut = inner[begin], inner[begin + length]
        a = 0
        while a < len(begin):
            b = a + 1
            while b < len(begin) and (b + 1 - a) * length[b] <= 100_000:
                b += 1
            self._viterbi(e, begin[a:b], length[a:b], after_cut[a:b], before_cut[a:b], labels)
            a = b
        return labels

    def _viterbi(self, e: np.ndarray, first: np.ndarray, length: np.ndarray, after_cut: np.ndarray, before_cut: np.ndarray, labels: np.ndarray) -> None:
        """Best paths of stretches; one after (before) a cut has the label "outside" before (after) it."""
        n, size = int(length[-1]), len(first)
        back = np.zeros((n, size, len(LABELS)), np.int8)
        best = np.where(after_cut[:, None], self.moves[0], self.begins) + e[first]
        for i in range(1, n):
            live = np.flatnonzero(length > i)
            step = best[live][:, :, None] + self.moves[None, :, :]
            back[i, live] = step.argmax(axis=1)
            best[live] = step.max(axis=1) + e[first[live] + i]
        label = (best + np.where(before_cut[:, None], self.moves[:, 0], 0)).argmax(axis=1)
        for i in range(n - 1, -1, -1):
            live = np.flatnonzero(length > i)
            labels[first[live] + i] = label[live]
            label[live] = back[i, live, label[live]]


def read_labelled(table: str) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, spans) for each line of a labelled table."""
    out = []
    for line in table.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[([a-z]+):([^\]]+)\]", line):
            text += line[at:m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out


def train(labelled: list[tuple[str, list[tuple[int, int, str]]]]) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient ascent over all sentences."""
    points = np.frombuffer("\n".join(t for t, _ in labelled).encode("utf-32-le"), np.int32)
    t = tokens(points)
    gold, at = np.zeros(len(t.start), np.int64), 0
    for text, spans in labelled:
        for a, b, kind in spans:
            held = np.flatnonzero((t.start < at + b) & (t.end > at + a))
            gold[held] = LABELS.index(kind)
        at += len(text) + 1
    keys = _feature_keys(t)
    known = np.unique(np.concatenate(keys))
    ids = np.stack([np.searchsorted(known, k) for k in keys], axis=1)
    size, n = len(LABELS), len(gold)
    w, moves, begins = np.zeros((len(known) + 1, size)), np.zeros((size, size)), np.zeros(size)
    first = np.flatnonzero(np.r_[True, t.line[1:] != t.line[:-1]])
    last = np.r_[first[1:], n] - 1
    for _ in range(PASSES):
        e = w[ids].sum(axis=1)
        fore, aft = np.zeros((n, size)), np.zeros((n, size))
        pair = np.zeros((size, size))
        is_first = np.zeros(n, bool)
        is_first[first] = True
        for i in range(n):
            fore[i] = e[i] + (begins if is_first[i] else np.logaddexp.reduce(fore[i - 1][:, None] + moves, axis=0))
        for i in range(n - 2, -1, -1):
            if not is_first[i + 1]:
                aft[i] = np.logaddexp.reduce(moves + (e[i + 1] + aft[i + 1])[None, :], axis=1)
        whole = np.zeros(n)
        for a, b in zip(first, last):
            whole[a:b + 1] = np.logaddexp.reduce(fore[b])
        expected = np.exp(fore + aft - whole[:, None])
        inner = np.flatnonzero(~is_first)
        for i in inner:
            pair -= np.exp(fore[i - 1][:, None] + moves + (e[i] + aft[i])[None, :] - whole[i])
        np.add.at(pair, (gold[inner - 1], gold[inner]), 1)
        error = -expected
        error[np.arange(n), gold] += 1
        slope = np.zeros_like(w)
        np.add.at(slope, ids.ravel(), np.repeat(error, ids.shape[1], axis=0))
        w += RATE * (slope - PENALTY * w)
        moves += RATE * 0.1 * (pair - PENALTY * moves)
        begins += RATE * 0.1 * (error[first].sum(axis=0) - PENALTY * begins)
    w[-1] = 0
    return Field(known, w.astype(np.float32), moves.astype(np.float32), begins.astype(np.float32))


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, place, end) of what the field finds in each text; place 4 and up in the order of ``KINDS``."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    t = tokens(points)
    label = field.decode(t)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    inner = np.r_[False, (label[1:] == label[:-1]) & (t.line[1:] == t.line[:-1])] if len(label) else label
    for i in np.flatnonzero((label > 0) & ~inner).tolist():
        j = i
        while j + 1 < len(label) and inner[j + 1]:
            j += 1
        row = int(np.searchsorted(begins, t.start[i], "right")) - 1
        a, b = int(t.start[i] - begins[row]), int(t.end[j] - begins[row])
        text = texts[row]
        while a < b and text[a] in "\"'<[{,;:":
            a += 1
        while b > a and (text[b - 1] in ".,;:!?\"'>]}" or text[b - 1] == ")" and "(" not in text[a:b]):
            b -= 1
        if a < b:
            out[row].append((a, 3 + int(label[i]), b))
    return out


def find_pii(docs: DataFrame, labelled: list[tuple[str, list[tuple[int, int, str]]]] | None = None) -> DataFrame:
    """doc_id, spans: array<struct<start, place, kind, end>> in order; kinds email, ip, card and phone by pattern, crf_* by the
    field where no pattern's span overlaps."""
    field = share(docs.sparkSession, train(read_labelled(LABELLED) if labelled is None else labelled))
    kinds = [*BASE, *[f"crf_{k}" for k in KINDS]]
    texts = id_and_text(docs)
    spans = T._parse_datatype_string("spans array<struct<start: int, place: int, kind: string, end: int>>").fields
    row_type = pa.struct([("start", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field()
        for batch in batches:
            for part in slices(batch, limit=1 << 19):
                rows = part.column("text").to_pylist()
                every = []
                for text, more in zip(rows, field_spans(model, rows)):
                    base = base_spans(text)
                    new = [s for s in more if not any(s[0] < b[2] and b[0] < s[2] for b in base)] if base else more
                    every.append([{"start": s, "place": p, "kind": kinds[p], "end": e} for s, p, e in sorted(base + new)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(every, pa.list_(row_type))], names=["doc_id", "spans"])

    return texts.mapInArrow(run, T.StructType([texts.schema["doc_id"], *spans]))


def op6_pii(docs: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return find_pii(docs).select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.filter("spans", lambda x: x["place"] < 4)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
