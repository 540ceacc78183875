"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, a span classifier is trained on the result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import table, with_columns, written

#: The first BASE kinds have base patterns, whose spans always stay; spans of all kinds are added by the method.
KINDS = ("email", "ip", "card", "phone", "secret", "name", "address")
BASE = 4
#: Characters before and after a span that context labelers see.
NEAR = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Candidates besides the base ones: forms that people write, which the base patterns don't take. Each repetition is bounded, or takes its whole run and can't start inside it, so a secret of any length is one span and time is linear in the text.
_UPPER, _LOWER = "A-Z\u00c0-\u00d6\u00d8-\u00de", "a-z\u00df-\u00f6\u00f8-\u00ff"
_SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\bat\b) ?[A-Za-z0-9-]{1,64} ?(?:\(dot\)|\[dot\]|\bdot\b) ?[A-Za-z]{2,12}\b")
_PLUS_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9.-])")
_GROUPS = re.compile(r"(?<![0-9A-Za-z=.])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])")
_KEYED = re.compile(r"(?i)\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|passwort|kennwort|contrase\u00f1a|mot de passe)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"'<>,;]{6,})")
_PREFIXED = re.compile(r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]++)?)(?![A-Za-z0-9])")
_MIXED = re.compile(r"(?<![A-Za-z0-9+/=_.-])[A-Za-z0-9+/_-]{20,}+")
_TITLED = re.compile(rf"\b(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Se\u00f1ora?|Sra?|Do\u00f1a)\.? ([{_UPPER}][{_LOWER}'-]{{1,30}}(?: [{_UPPER}][{_LOWER}'-]{{1,30}}){{0,2}})(?![{_LOWER}])")
_CAPITALS = re.compile(rf"(?<![\w@.'-])[{_UPPER}][{_LOWER}]{{1,30}}(?: [{_UPPER}]\.)?(?: [{_UPPER}][{_LOWER}'-]{{1,30}}){{1,2}}(?![\w-])")
_STREET = re.compile(
    rf"\b[0-9]{{1,5}}[A-Za-z]? (?:[A-Z][a-z]{{1,20}} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Court|Way|Place|Square)\b"
    rf"|\b[{_UPPER}][{_LOWER}]{{2,30}}(?:stra\u00dfe|strasse|weg|platz|allee|gasse) [0-9]{{1,5}}[a-z]?\b"
    rf"|\b(?:[0-9]{{1,5}},? )?(?:rue|avenue|boulevard|calle|avenida|plaza) (?:(?:de|du|des|la|le|las|los|del) ){{0,2}}[{_UPPER}][{_LOWER}]{{1,30}}(?:,? [0-9]{{1,5}}\b)?"
)

# Fixed values of the gazetteers: common last labels of mail hosts, first digits of cards, country calling codes, starts of issued keys, common given names; and words near personal data.
_LAST_LABELS = frozenset("com org net edu gov mil int info biz name pro dev app io co uk de fr es it nl be ch at eu us ca au nz ie pt pl se no dk fi cz gr ru ua tr in cn jp kr br mx ar cl za".split())
_FIRST_DIGITS = frozenset("3456")
_CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 420 421".split())
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "AIza", "eyJ")
_PLACEHOLDERS = frozenset("required optional password changeme example placeholder undefined unknown disabled enabled default string secret hidden redacted".split())
_GIVEN = frozenset(
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kevin Brian George Edward Peter Henry Frank Samuel Alexander "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Rebecca Laura Helen Emma Olivia Alice Anna "
    "Hans Klaus Wolfgang Stefan Andreas Matthias Uwe Dieter Jens Lukas Felix Ursula Monika Petra Sabine Claudia Katrin Heike Anja Birgit "
    "Jean Pierre Michel Philippe Alain Nicolas Christophe Laurent Julien Antoine Marie Nathalie Isabelle Sylvie Catherine Martine Sophie Camille Chloe Juliette "
    "Antonio Manuel Francisco Juan Pedro Carlos Javier Miguel Luis Fernando Diego Carmen Josefa Isabel Dolores Pilar Teresa Lucia Elena Marta Rosa".split()
)
_NOT_NAMES = frozenset("The This That These Those And But For With From Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December New North South East West University Street Road".split())
_WORDS = {
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|reply|adresse|correo|courriel)\b"),
    "ip": re.compile(r"(?i)\b(?:ip|host|server|address|login|adresse|addr)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|payment|karte|carte|tarjeta|account)\b"),
    "phone": re.compile(r"(?i)\b(?:phone|call|tel|mobile|fax|sms|telefon|t[e\u00e9]l[e\u00e9]phone|llame)\b"),
    "secret": re.compile(r"(?i)(?:password|passwd|passphrase|pwd|secret|token|key|credential|login|auth|bearer|passwort|kennwort|contrase\u00f1a|mot de passe)"),
    "name": re.compile(r"(?i)\b(?:name|named|called|contact|signed|regards|dear|born|married|author|hei\u00dft|hei\u00dfe|geboren|nomm\u00e9e?|appelle|llama|nacid[oa]|mrs?|ms|dr|herr|frau|madame|monsieur|se\u00f1ora?)\b"),
    "address": re.compile(r"(?i)\b(?:address|lives?|living|home|visit|located|deliver|adresse|wohnt|wohnhaft|habite|domicile|direcci\u00f3n|vive|domicilio|zip|postcode)\b"),
}
_NOT_PERSONAL = re.compile(r"(?i)(?:\b(?:version|isbn|order|invoice|id|no|nr|sku|total|page|chapter|section|commit|sha\d*|md5|hash|checksum|digest|uuid|build|revision)\b[ :#=]*|[#$\u20ac\u00a3/])$")
_COMPANY = re.compile(r"^,? (?:Inc|Ltd|LLC|GmbH|AG|Corp|Co|SA|SARL|University|Street|Road|Avenue)\b")

#: Two bits of a candidate's votes for each labeler: for, against; neither: it abstains.
LABELERS = ("strict form", "loose form", "gazetteer", "words near", "clean borders", "other meaning")
#: What the classifier sees of a span: levels of its shape, none of them a vote. Their product bounds the patterns that there are.
SHAPE = {"kind": len(KINDS), "length": 6, "digits": 4, "case": 4, "opening": 5, "before": 5, "after": 5, "checksum": 3}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind, then start. In time linear in the text."""
    out, digits = [], _DIGIT.search(text)
    if "@" in text:
        floor = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                floor = m.end()
    if digits:
        for m in _DOTTED.finditer(text, digits.start()):
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                end = at + len(".".join(parts[k : k + 4]))
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[k : k + 4]):
                    out.append((1, at, end))
                at = end + 1
        for m in _CARD.finditer(text, digits.start()):
            if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "dot" in text:
        out += [(0, *m.span()) for m in _SPELT.finditer(text)]
    if _DIGIT.search(text):
        out += [(2, *m.span()) for m in _GROUPS.finditer(text)]
        out += [(3, *m.span()) for m in _PLUS_PHONE.finditer(text)] if "+" in text else []
        out += [(3, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        out += [(4, *m.span()) for m in _MIXED.finditer(text) if _switches(m[0]) >= 3]
        out += [(6, *m.span()) for m in _STREET.finditer(text)]
    if any(start in text for start in _KEY_STARTS):
        out += [(4, *m.span()) for m in _PREFIXED.finditer(text)]
    if "=" in text or ":" in text:
        out += [(4, *m.span(1)) for m in _KEYED.finditer(text)]
    out += [(5, *m.span(1)) for m in _TITLED.finditer(text)]
    return out + [(5, *m.span()) for m in _CAPITALS.finditer(text) if m[0].split(" ", 1)[0] in _GIVEN]


def _switches(s: str) -> int:
    """How often letters and digits take turns."""
    digit = [c.isdigit() for c in s if c.isalnum()]
    return sum(a != b for a, b in zip(digit, digit[1:]))  # noqa: B905


def _border(c: str, sentence: str) -> int:
    return 0 if not c or c.isspace() else 1 if c in "\"'()[]<>{}" else 2 if c in sentence else 3 if c.isalnum() else 4


def votes_and_shape(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, int]:
    """Bit 2k: labeler k votes for personal data, bit 2k + 1: against. And the number of the span's pattern of SHAPE."""
    span, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    digits = "".join(c for c in span if c in "0123456789")
    letters = [c for c in span if c.isalpha()]
    other = bool(_NOT_PERSONAL.search(before))
    strict, against = base, False
    if kind == 0:
        known = re.split(r"[. ]", span.rstrip(")]"))[-1].lower() in _LAST_LABELS
        loose = "." in span or "dot" in span
    elif kind == 1:
        known, loose = 1 <= int(span.split(".")[0]) <= 223, True
    elif kind == 2:
        known, loose = digits[:1] in _FIRST_DIGITS, 13 <= len(digits) <= 19 and luhn(digits)
    elif kind == 3:
        known, loose = span[0] == "+" and digits.startswith(_CALLING), 7 <= len(digits) <= 15
    elif kind == 4:
        keyed = bool(re.search(r"[:=][ \t]{0,3}[\"']?$", before))
        known = span.startswith(_KEY_STARTS)
        loose, against = bool(digits) and bool(letters) and len(set(span)) >= 6, span.lower().strip(".") in _PLACEHOLDERS
        strict = known or keyed and loose
    elif kind == 5:
        words = span.split(" ")
        strict, known, loose = bool(re.search(r"\b(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Mlle|Se\u00f1ora?|Sra?|Do\u00f1a)\.? $", before)), words[0] in _GIVEN and not _NOT_NAMES.intersection(words), len(words) >= 2
        against, other = not _NOT_NAMES.isdisjoint(words), bool(_COMPANY.match(after)) or (not strict and (not before.rstrip() or before.rstrip()[-1] in ".!?"))
    else:
        known, loose = True, bool(digits)
        strict, against = bool(digits) and span[0] in "0123456789" or bool(re.search(r"(?:stra\u00dfe|strasse|weg|platz|allee|gasse) [0-9]", span)), not digits
    near = bool(_WORDS[KINDS[kind]].search(before) or _WORDS[KINDS[kind]].search(after[:16]))
    borders = (not before or before[-1] in " \t\n\r(\"'<:,;=") and (not after or after[0] in " \t\n\r)\"'>,;.!?")
    votes = [(strict, False), (loose, not loose), (known, against), (near, False), (False, not borders), (False, other)]
    size, share = len(span), len(digits) / len(span)
    levels = [
        kind, sum(size >= x for x in (8, 12, 16, 20, 40)), 0 if not digits else 3 if len(digits) == size else 1 + (share >= 0.5), 0 if not letters else 3 if not (span.islower() or span.isupper()) else 1 + span.isupper(),
        "+(".find(span[0]) + 1 if span[0] in "+(" else 3 + span[0].isalpha() if span[0].isalnum() else 0, _border(before[-1:], ":="), _border(after[:1], ".,;:!?"), 0 if len(digits) < 13 or letters else 1 + luhn(digits),
    ]
    shape = 0
    for level, n in zip(levels, SHAPE.values(), strict=True):
        shape = shape * n + level
    return sum((1 << 2 * i) * a + (1 << 2 * i + 1) * (b and not a) for i, (a, b) in enumerate(votes)), shape


SPAN = "struct<kind:int,start:long,end:long,base:boolean,votes:int,shape:int>"


def candidates(docs: DataFrame, *, with_text: bool = False) -> DataFrame:
    """docs (text and any others but spans), with spans: base ones, and loose ones that overlap no base one and none before them. The text stays only if asked for."""
    kept = [c for c in docs.columns if with_text or c != "text"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "start", "end", "base", "votes", "shape"]
        span = pa.struct(list(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()], strict=True)))
        for batch in chunks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                row = []
                if text:
                    base = base_spans(text)
                    taken = sorted((s, e) for _, s, e in base)
                    loose, last, at = [], 0, 0
                    for k, s, e in sorted(loose_spans(text), key=lambda x: (x[1], -x[2], x[0])):
                        while at < len(taken) and taken[at][1] <= s:
                            at += 1
                        if s >= last and not any(b < e and s < f for b, f in taken[at : at + BASE]):
                            loose.append((k, s, e))
                            last = e
                    for strict, spans in ((True, base), (False, loose)):
                        row += [dict(zip(names, (k, s, e, strict, *votes_and_shape(text, k, s, e, strict)), strict=True)) for k, s, e in spans]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, pa.list_(span))], [*kept, "spans"])

    return docs.mapInArrow(found, with_columns([f for f in docs.schema if f.name in kept], f"spans array<{SPAN}>"))


#: What the estimates start from and are drawn to: per labeler, how likely it abstains, votes for or against, given personal data and given not. It says which labelers are the better ones, as votes alone could as well mean the reverse.
BELIEF = {
    "strict form": ((0.3, 0.65, 0.05), (0.85, 0.1, 0.05)), "loose form": ((0.05, 0.93, 0.02), (0.05, 0.35, 0.6)), "gazetteer": ((0.35, 0.6, 0.05), (0.55, 0.25, 0.2)),
    "words near": ((0.65, 0.3, 0.05), (0.9, 0.05, 0.05)), "clean borders": ((0.85, 0.05, 0.1), (0.6, 0.05, 0.35)), "other meaning": ((0.93, 0.05, 0.02), (0.55, 0.05, 0.4)),
}
#: The belief counts as this many spans, and this share of those there are.
BELIEF_SPANS, BELIEF_SHARE = 5.0, 0.25


def reliabilities(counts: list[tuple[int, int, int]], rounds: int = 100) -> tuple[dict[tuple[int, int], float], np.ndarray]:
    """Expectation-maximisation. counts: (kind, votes, spans with these), of all spans. Gives the chance of personal data for each (kind, votes), and per kind, labeler and truth (given personal data, given not) how likely the labeler abstains, votes for or against."""
    of, k = {}, len(LABELERS)
    belief = np.array([BELIEF[name] for name in LABELERS])
    reliability = np.tile(belief[None], (len(KINDS), 1, 1, 1))
    for kind in sorted({c[0] for c in counts}):
        votes, weight = (np.array(x) for x in zip(*sorted((v, n) for c, v, n in counts if c == kind), strict=True))
        vote = np.stack([votes >> 2 * i & 3 for i in range(k)], axis=1)  # 0: none, 1: for, 2: against
        one_hot = np.stack([vote == v for v in range(3)], axis=2).astype(float)
        if kind < BASE:  # a span that the base patterns don't take can't have the strict form: that it hasn't says nothing
            one_hot[:, LABELERS.index("strict form"), 0] = 0
        held, prior, strength = belief, 0.5, BELIEF_SPANS + BELIEF_SHARE * weight.sum()
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + (one_hot * (np.log(held[:, 0]) - np.log(held[:, 1]))).sum(axis=(1, 2))
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            prior = float(np.clip((weight @ q + 1) / (weight.sum() + 2), 0.02, 0.98))
            held = np.stack([(one_hot * (weight * p)[:, None, None]).sum(axis=0) + strength * belief[:, t] for t, p in enumerate((q, 1 - q))], axis=1)
            held = held / held.sum(axis=2, keepdims=True)
        reliability[kind] = held
        of |= {(kind, v): p for v, p in zip(votes.tolist(), q.tolist(), strict=True)}
    return of, reliability


@dataclass
class SpanModel:
    """The span classifier: per kind a logistic regression on the other levels of SHAPE, and the least log-odds from which a span is added."""

    intercepts: list[float]
    #: Per level, the weight for kind k and value v at k * (values of the level) + v.
    weights: dict[str, list[float]]
    cuts: list[float]

    def log_odds(self, shape: Column) -> tuple[Column, Column]:
        """(kind, log-odds)."""
        values, rest = {}, shape
        for name, n in reversed(SHAPE.items()):
            values[name] = F.pmod(rest, F.lit(n))
            rest = F.floor(rest / n).cast("int")
        literal = lambda x: F.array(*[F.lit(float(v)) for v in x])
        z = F.get(literal(self.intercepts), values["kind"])
        for name, w in self.weights.items():
            z = z + F.get(literal(w), values["kind"] * SHAPE[name] + values[name])
        return values["kind"], z

    def added(self, shape: Column) -> Column:
        kind, z = self.log_odds(shape)
        return z >= F.get(F.array(*[F.lit(float(c)) for c in self.cuts]), kind)


#: Of the classifier's ridge.
RIDGE = 0.1


def train(patterns: list[tuple[int, bool, float, float]], precision: float) -> SpanModel:
    """patterns: (shape, base, spans with it, the sum of their chances), of all spans. A span is added from the log-odds on at which those added, by the labelers' estimates, are personal data in at least `precision` of all cases, and not below even odds; a kind without such a point adds none."""
    names = list(SHAPE)[1:]
    model = SpanModel([0.0] * len(KINDS), {n: [0.0] * (len(KINDS) * SHAPE[n]) for n in names}, [float("inf")] * len(KINDS))
    if not patterns:
        return model
    shape, base, n, mass = (np.array(x) for x in zip(*sorted(patterns), strict=True))
    levels, rest = {}, shape
    for name, values in reversed(SHAPE.items()):
        levels[name], rest = rest % values, rest // values
    for kind in np.unique(levels["kind"]).tolist():
        own = levels["kind"] == kind
        x = np.concatenate([(levels[m][own][:, None] == np.arange(SHAPE[m])).astype(float) for m in names] + [np.ones((int(own.sum()), 1))], axis=1)
        weight, q, w = n[own], mass[own] / n[own], np.zeros(x.shape[1])
        for _ in range(50):  # Newton's steps, with a ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (weight * (p - q)) + RIDGE * w)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        model.intercepts[kind], at = float(w[-1]), 0
        for m in names:
            model.weights[m][kind * SHAPE[m] : (kind + 1) * SHAPE[m]] = w[at : at + SHAPE[m]].tolist()
            at += SHAPE[m]
        z, loose = x @ w, ~base[own]
        order = np.argsort(-z[loose], kind="stable")
        z, good, all_ = z[loose][order], np.cumsum(mass[own][loose][order]), np.cumsum(weight[loose][order])
        whole = np.append(z[:-1] > z[1:], True)[: len(z)]  # spans of equal odds are added together
        fits = np.flatnonzero(whole & (z >= 0) & (good >= precision * all_))
        if len(fits):
            model.cuts[kind] = float(z[fits[-1]]) - 1e-9
    return model


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.9) -> DataFrame:
    """Every row's doc_id and spans: array of (kind, start, end, base): base ones all, and others that the classifier adds.

    Tasks find candidates in whole texts, with each labeler's vote and the levels of their shape. The cluster counts how
    many spans have each pattern of votes (at most 7 times 3^6, however many documents), from which the driver estimates
    the labelers' reliabilities and each pattern's chance of personal data; then it counts spans and sums their chances
    by shape (at most the product of SHAPE's levels, 252 000), from which the driver trains the classifier and its cuts. Null and
    empty texts have no spans. Rows may repeat, ids be null. More columns aren't read. An empty table gives an empty one.
    """
    return annotate(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), precision=precision).select("doc_id", "spans")


def annotate(docs: DataFrame, *, precision: float = 0.9, with_text: bool = False) -> DataFrame:
    """docs (text and any others but spans) with their spans, as find() has them."""
    found = written(candidates(docs, with_text=with_text), "pii-candidates")
    spans = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape", "s.base").agg(F.count("*").alias("n"))
    counted = written(spans, "pii-patterns")
    chances, _ = reliabilities([tuple(r) for r in counted.groupBy("kind", "votes").agg(F.sum("n")).collect()])
    chance = F.broadcast(docs.sparkSession.createDataFrame([(*key, q) for key, q in chances.items()], "kind int, votes int, q double"))  # 7 x 3^6 rows at most
    shapes = counted.join(chance, ["kind", "votes"]).groupBy("shape", "base").agg(F.sum("n").cast("double"), F.sum(F.col("n") * F.col("q")))
    model = train([tuple(r) for r in shapes.collect()], precision)
    kept = F.filter("spans", lambda s: s["base"] | model.added(s["shape"]))
    return found.withColumn("spans", F.array_sort(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))))


def redacted(text: Column, spans: Column) -> Column:
    """A text with each of its spans replaced by its kind in angle brackets; overlapping spans are replaced as one, by the kind of the first and then the longest."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    after = lambda at: F.substring(text, (at + 1).cast("int"), F.length(text))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.get(names, s["kind"]))
        return F.when(s["start"] >= acc["at"], F.struct(piece.alias("out"), (-s["end"]).alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], -s["end"]).alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    return F.when(F.size(spans) > 0, F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], after(acc["at"])))).otherwise(text)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op4_personal_data(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds, added = F.transform(base, lambda s: s["kind"]), F.transform(F.filter("spans", lambda s: ~s["base"]), lambda s: s["kind"])
    of = lambda kinds, k: (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long")
    counts = [of(kinds, k).alias(f"n_{name}") for k, name in enumerate(KINDS[:BASE])] + [of(added, k).alias(f"added_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
