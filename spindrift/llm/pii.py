"""PII by candidate gradient boosting.

Base spans (email, ip, card, phone) come from fixed formats with their checks and always stay. High-recall
generators then propose further, overlapping spans: spelled-out or loose addresses, phone
numbers without a plus, loosely grouped cards, IPv6, identity and account numbers, street addresses, and secrets (values
given to passwords, tokens and keys, the formats of well-known access keys, private keys, long random strings). Boosted trees read a candidate's format and the words
around it, isotonic calibration turns the score into a probability, and a threshold for each
kind, set for precision on held-out candidates, selects what is added; of overlapping candidates the most likely
one stays, and none may touch a base span.

The trees are trained when first used, on candidates that a seeded generator builds from format rules, so no
rows of the corpus are needed.

Work is linear in the text and its candidates: addresses are found from their @ sign outwards, number runs from their first
digit, long strings from their beginning, and overlaps by marking what is taken. Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; digits are ASCII; rows that repeat are scanned one by one;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.boosting import fit_boosted, fit_isotonic
from spindrift.llm.common import text_or_empty

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret", "address")
BASE = KINDS[:4]
# The base formats.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    out = list(_emails(text)) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


_WORD = r"[A-Za-z0-9][A-Za-z0-9_%+-]{0,40}"
_DOT = r"(?: ?[\[(]dot[\])] ?| dot |\.)"
_HEX = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
_SECRET_NAMES = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|client[_-]?secret|private[_-]?key|credentials?"
# kind, what a text must have for the pattern to match anywhere, pattern, group of the span
GENERATORS = (
    ("email", "at", re.compile(rf"\b{_WORD}(?:{_DOT}{_WORD}){{0,3}}(?: ?[\[(]at[\])] ?| at | ?@ ?){_WORD}(?:{_DOT}{_WORD}){{1,3}}", re.I), 0),
    ("phone", "digit", re.compile(r"(?<![0-9])\(?0?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"), 0),
    ("phone", "digit", re.compile(r"(?<![0-9.])0[0-9]{8,11}(?![0-9])"), 0),
    ("phone", "digit", re.compile(r"(?<![0-9.])00[1-9][0-9]{0,2}(?:[ ().-]{1,2}[0-9]{2,4}){2,5}(?![0-9])"), 0),
    ("card", "digit", re.compile(r"(?<![0-9])[0-9]{4}(?:[._/\u00a0-]|  )[0-9]{4}(?:[._/\u00a0-]|  )[0-9]{4}(?:[._/\u00a0-]|  )[0-9]{1,7}(?![0-9])"), 0),
    ("ip", ":", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Fa-f:])"), 0),
    ("ip", ":", re.compile(rf"(?<![0-9A-Za-z_])(?<![0-9A-Fa-f:]:)(?:{_HEX}::(?:{_HEX})?|::{_HEX})(?![0-9A-Za-z_:])"), 0),
    ("ssn", "digit", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"), 0),
    ("iban", "digit", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"), 0),
    ("secret", "=:", re.compile(rf"(?:{_SECRET_NAMES})[\"']?[ \t]{{0,2}}(?:=>?|:)[ \t]{{0,2}}[\"']?([^\s\"',;<>]{{6,}})", re.I), 1),
    ("secret", "digit", re.compile(r"(?<![0-9A-Za-z_-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{30,}|sk[-_][0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})(?![0-9A-Za-z_-])"), 0),
    ("secret", "-----", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----"), 0),
    ("secret", "digit", re.compile(r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_-]{24,}={0,2}(?![0-9A-Za-z+/_=-])"), 0),
    ("address", "digit", re.compile(r"\b[0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square|Way)\b\.?"), 0),
    ("address", "digit", re.compile(r"\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|gasse|platz|allee) [0-9]{1,4}[a-z]?\b"), 0),
)
CUES = {
    "email": ("mail", "contact", "write", "reach", "email", "correo", "courriel"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "dial", "anruf", "ring", "text me"),
    "ip": ("ip", "host", "server", "address", "addr", "client"),
    "card": ("card", "visa", "credit", "pay", "karte", "tarjeta", "carte"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "secret": ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential"),
    "address": ("live", "address", "ship", "home", "wohn", "mail to", "anschrift"),
    "not": ("version", "order", "isbn", "invoice", "part", "model", "page", "date", "ref", "commit", "hash", "serial", "price", "meet", "look"),
    "sum": ("commit", "sha", "md5", "hash", "checksum", "digest", "etag", "uuid", "rev", "blob", "file", "path", "url", "http", "id"),
}
_ASSIGNED = re.compile(r"[=:]>?\s{0,2}[\"']?$")
_KNOWN = re.compile(r"A[KS]IA[0-9A-Z]{16}$|gh[pousr]_|sk[-_]|xox[abprs]-|AIza|eyJ|-----BEGIN")
_VOWELS = re.compile(r"[aeiouy]", re.I)
# words that stand before "at" and a place, not before an address
PLACED = frozenset("us me you it them him her available online found site website page pages look looking visit more information details hosted located live read see this that here and is are was".split())


def candidates(text: str) -> list[Span]:
    """Every generator's spans; they may overlap."""
    low = None
    digit = _DIGIT.search(text) is not None
    out = []
    for kind, needs, pattern, group in GENERATORS:
        if needs == "digit" and not digit or needs in (":", "-----") and needs not in text or needs == "=:" and "=" not in text and ":" not in text:
            continue
        if needs == "at":
            low = text.lower()
            if "@" not in text and " at " not in low and "at)" not in low and "at]" not in low:
                continue
        if kind == "secret" and needs == "digit":  # a long string without a digit is a word, and a number without a letter is no secret
            out += [(kind, *m.span(group)) for m in pattern.finditer(text) if _DIGIT.search(m[group]) and not m[group].isdecimal()]
        else:
            out += [(kind, *m.span(group)) for m in pattern.finditer(text)]
    return out


def _entropy(s: str) -> float:
    counts = np.array(list(Counter(s).values()))
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum())


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _secret_features(s: str, before: str) -> tuple[float, ...]:
    letters = [c for c in s if c.isalpha()]
    turns = sum(a.isdecimal() != b.isdecimal() for a, b in zip(s, s[1:]))
    return (
        _entropy(s),
        float(all(c in "0123456789abcdef" for c in s)),
        sum(c.isupper() for c in letters) / len(s),
        sum(c.islower() for c in letters) / len(s),
        turns / len(s),
        float(bool(_KNOWN.match(s))),
        float(bool(_ASSIGNED.search(before))),
        len(_VOWELS.findall(s)) / max(1, len(letters)),
        sum(c in "/._-" for c in s) / len(s),
    )


def describe(text: str, span: Span) -> list[float]:
    """Format and context features of a candidate."""
    kind, a, b = span
    s = text[a:b]
    before, after = text[max(0, a - 32) : a].lower(), text[b : b + 16].lower()
    digits = _DIGIT.findall(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    last = re.split(r"[.\s)\]]+", s.lower())[-1]
    short = "::" in s and kind == "ip"
    return [
        *[float(kind == k) for k in KINDS],
        len(s),
        len(digits),
        len(groups),
        max(groups, default=0),
        groups[-1] if groups else 0,
        sum(c in " " for c in s),
        sum(c in "-" for c in s),
        sum(c in "." for c in s),
        sum(c in "()[]" for c in s),
        float("@" in s),
        float(bool(re.search(r"[\[(](at|dot)[\])]", s, re.I))),
        float(" dot " in s.lower()),
        float(" at " in s.lower()),
        float(kind == "email" and re.split(r"[^a-z0-9]", s.lower())[0] in PLACED),
        s.count(":"),
        s.count("::"),
        float(short and s.lower().startswith(("fe80:", "fc", "fd", "ff0", "2001:", "2a0", "2600:", "2606:", "2620:"))),
        float(short and not digits),
        float(last in ("com", "org", "net", "edu", "de", "fr", "es", "io", "uk", "info")),
        len(last),
        float(bool(re.match(r"(19|20)[0-9]{2}\b", s)) or bool(re.search(r"\b(19|20)[0-9]{2}$", s))),
        float(s[:1] == "0" or s[:1] == "("),
        float(kind == "iban" and _iban_ok(s)),
        float(kind == "ssn" and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00"),
        len(set(c for c in s.lower() if c in "abcdef")),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(kind == "card" and 13 <= len(digits) <= 19 and luhn("".join(digits))),
        *(_secret_features(s, before) if kind == "secret" else (0.0,) * 9),
        *[float(any(c in before for c in cues)) for cues in CUES.values()],
        float(any(c in before for c in CUES.get(kind, ()))),
    ]


def _synthetic(seed: int, n: int) -> list[tuple[str, str, bool]]:
    """(text, kind, is it personal data): candidates in context, built from format rules."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "be", "co", "di", "el", "fu", "ga", "ho", "in", "ka", "lo", "mi", "no", "or", "pa", "re", "st", "ti", "un", "ve")) for _ in range(r.randint(1, 4)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    tld = lambda: r.choice(("com", "org", "net", "de", "fr", "es", "io", "co.uk".split(".")[0] + ".uk"))

    def iban() -> str:
        body = r.choice(("DE", "FR", "ES", "GB")) + "00" + d(r.choice((16, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        s = f"{body[:2]}{check:02d}{body[4:]}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    placed, plain = sorted(PLACED), ("add", "bad", "bed", "dead", "face", "fade", "a", "b", "c", "cafe", "abc", "feed", "dec")

    def short_ip() -> str:
        head = r.choice(("fe80", "2001:db8", "2a02:" + hexa(4), "fd" + hexa(2), hexa(4) + ":" + hexa(4), "2001:" + hexa(4) + ":" + hexa(4), ""))
        tail = ":".join(hexa(r.randint(1, 4)) for _ in range(r.randint(1, 6 - head.count(":"))))
        return f"{head}::{r.choice((tail, tail, '1', '')) if head else r.choice(('1', 'ffff:' + hexa(4), tail))}"

    anyof = lambda cs, lo, hi: "".join(r.choice(cs) for _ in range(r.randint(lo, hi)))
    upper, alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    town = lambda: word().capitalize()

    def card(ok: bool) -> str:
        body = r.choice("3456") + d(14)
        check = next(c for c in "0123456789" if luhn(body + c) == ok)
        sep = r.choice((".", "_", "/", "\u00a0", "  "))
        s = body + check
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def known() -> str:
        return r.choice((
            *[r.choice(("AKIA", "ASIA")) + anyof(upper + "0123456789", 16, 16)] * 2, "ghp_" + anyof(alnum, 36, 36), "sk-" + anyof(alnum, 24, 48), f"xoxb-{d(11)}-{anyof(alnum, 20, 24)}", "AIza" + anyof(alnum + "_-", 35, 35),
            f"eyJ{anyof(alnum, 20, 40)}.{anyof(alnum, 30, 80)}.{anyof(alnum + '_-', 30, 43)}",
        ))

    def given() -> tuple[str, str]:
        """(what stands before, the secret)"""
        name = r.choice(("password", "passwd", "pwd", "Password", "token", "api_key", "apikey", "API-Key", "secret", "client_secret", "access_key", "auth", "Authorization", "bearer"))
        value = r.choice((hexa(r.randint(12, 64)), anyof(alnum, 10, 40), anyof(alnum + "!#$%+_-", 9, 24), word() + r.choice("!_-#") + d(r.randint(2, 4)) + r.choice(upper)))
        quote = r.choice(("", "", '"', "'"))
        return f"{name}{r.choice(('=', ' = ', ': ', ':', '=' ))}{quote}", value

    def harmless() -> tuple[str, str]:
        name = r.choice(("password", "token", "secret", "auth", "key=1 pass", "Token", "passcode"))
        return r.choice((
            (f"{name}: ", word() + word() + word()), (f"{name}=", "required"), (f"{name} = ", word() + "_" + word()), (f"{name}: ", "".join(("must", word(), "be"))), (f"{name}=", "********"), (f"{name}: ", "${" + word().upper() + "}"),
            (r.choice(("commit ", "sha1 ", "sha256:", "md5: ", "etag ", "digest ", "rev ", "checksum ", "")), hexa(r.choice((32, 40, 64)))),
            (r.choice(("uuid ", "id ", "")), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}"),
            (r.choice(("file ", "path ", "http://a.b/", "")), "/".join(word() for _ in range(r.randint(4, 7))) + d(2)), ("", "-".join(word() for _ in range(r.randint(4, 7))) + "-" + d(4)), ("", word() + "_" + word() + "_" + word() + "_" + word() + d(1) + "_" + word() * 2),
            (r.choice(("order ", "serial ", "part ", "")), "-".join(d(4) + r.choice(upper) for _ in range(6))),
        ))

    yes = {
        "email": lambda: r.choice(
            (f"{word()}{r.choice(('', '.', '_'))}{word()} [at] {word()} [dot] {tld()}", f"{word()}(at){word()}.{tld()}", f"{word()}{r.choice(('', '.', '_'))}{word()} [at] {word()}.{tld()}", f"{word()}.{word()}(at){word()}.{tld()}", f"{word()} at {word()} dot {tld()}", f"{word()} at {word()}.{tld()}", f"{word()} @ {word()}.{tld()}")
        ),
        "phone": lambda: r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(9)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}.{d(3)}.{d(4)}")),
        "ip": lambda: short_ip() if r.random() < 0.5 else ":".join(hexa(r.randint(1, 4)) for _ in range(8)),
        "ssn": lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
        "iban": iban,
        "card": lambda: card(True),
        "secret": lambda: known() if r.random() < 0.4 else given(),
        "address": lambda: r.choice((f"{r.randint(1, 9999)} {town()} {r.choice(('Street', 'Avenue', 'Road', 'Lane', 'St', 'Blvd'))}", f"{town()}{r.choice(('straße', 'weg', 'gasse', 'platz'))} {r.randint(1, 200)}")),
    }
    no = {
        "email": lambda: r.choice((f"{word()} at {word()}.{word()}", f"{word()} at {word()}. {word()}", f"{word()} at {d(2)}.{d(2)}", f"{word()} at {word()} dot {word()}", f"{r.choice(placed)} at {word()}.{tld()}", f"@ {word()}.{word()}")),
        "phone": lambda: r.choice((f"{r.randint(1900, 2030)}-{d(4)}-{d(4)}", f"{d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}/{d(4)}-{d(3)}", f"0{d(10)}")),
        "ip": lambda: r.choice((":".join(d(2) for _ in range(r.randint(4, 6))), f"{d(2)}:{d(2)}:{d(2)}:{d(3)}", "::".join(word()[:2] for _ in range(4)), f"{r.choice(plain)}::{r.choice(plain)}", f"{d(2)}::{d(2)}", f"{d(1)}::", f"::{r.choice(plain)}", f"{r.choice(plain)}::")),
        "ssn": lambda: r.choice((f"{d(3)} {d(2)} {d(4)}", f"9{d(2)}-{d(2)}-{d(4)}", f"000-{d(2)}-{d(4)}")),
        "iban": lambda: r.choice("ABCDEFGHIJ") + r.choice("KLMNOPQR") + d(2) + " " + " ".join(d(4) for _ in range(4)),
        "card": lambda: card(False),
        "secret": harmless,
        "address": lambda: r.choice((f"{r.randint(1, 9999)} {town()} {r.choice(('Way', 'Square', 'Court'))}", f"{r.randint(1900, 2030)} {town()} Drive", f"{r.randint(1, 40)} {town()} {town()} Road")),
    }
    out = []
    for _ in range(n):
        kind, true = r.choice([*yes, "secret", "secret"]), r.random() < 0.5
        made = (yes if true else no)[kind]()
        lead, made = made if isinstance(made, tuple) else ("", made)
        cues = CUES[kind] if true else CUES["not"]
        cue = f" {r.choice(cues)}{r.choice(('', ':', ' is', ' no.'))}" if r.random() < (0.55 if true else 0.7) else ""
        if lead:
            cue = ""
        if true and not cue and kind in ("phone", "ssn", "address") and r.random() < 0.5:
            true = False  # a bare number alone says little
        if true and not cue and (kind == "email" and " at " in made and "." in made or kind == "ip" and made.startswith("::")) and r.random() < 0.6:
            true = False  # nor does a place, or a single group
        text = " ".join(word() for _ in range(r.randint(0, 6))) + f"{cue} "
        out.append((text + lead + "\0" + made + "\0" + r.choice((" ", " ", '"') if kind == "secret" else (".", " ", ",")) + " ".join(word() for _ in range(3)), kind, true))
    return out


class Redactor:
    """The fitted trees, their calibration and a threshold for each kind."""

    def __init__(self, seed: int = 7, n: int = 16000, precision: float = 0.97):
        xs, ys, ks = [], [], []
        for marked, kind, true in _synthetic(seed, n):
            a = marked.index("\0")
            b = marked.index("\0", a + 1) - 1
            text = marked.replace("\0", "")
            for span in candidates(text):
                if span[0] == kind and span[1] < b and span[2] > a:
                    xs.append(describe(text, span))
                    ys.append(true and abs(span[1] - a) <= 1 and abs(span[2] - b) <= 1)
                    ks.append(kind)
        x, y, k = np.array(xs), np.array(ys, float), np.array(ks)
        part = np.arange(len(x)) % 4  # two parts fit, one calibrates, one sets the thresholds
        self.trees = fit_boosted(x[part < 2], y[part < 2], rounds=90)
        self.calibrate = fit_isotonic(self.trees.raw(x[part == 2]), y[part == 2])
        p = self.calibrate(self.trees.raw(x[part == 3]))
        self.threshold = {}
        for kind in set(KINDS):
            own, hit = p[k[part == 3] == kind], y[part == 3][k[part == 3] == kind]
            fine = [t for t in np.unique(own) if hit[own >= t].mean() >= precision]
            self.threshold[kind] = max(0.8, float(min(fine))) if fine else 2.0

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by kind, then start."""
        base, proposed = base_spans(text), list(dict.fromkeys(candidates(text)))
        added: list[Span] = []
        if proposed:
            taken = bytearray(len(text))  # a mark on every character of a selected span
            for _, a, b in base:
                taken[a:b] = b"\1" * (b - a)
            free = [s for s in proposed if taken.find(1, s[1], s[2]) < 0]
            for i in range(0, len(free), 4096):
                part = free[i : i + 4096]
                p = self.calibrate(self.trees.raw(np.array([describe(text, s) for s in part])))
                added += [(-prob, s) for prob, s in zip(p.tolist(), part) if prob >= self.threshold[s[0]]]
            # the most likely first; of equals the longest, then the first
            ranked = sorted(added, key=lambda x: (x[0], x[1][1] - x[1][2], x[1]))
            added = []
            for _, (kind, a, b) in ranked:
                if taken.find(1, a, b) < 0:
                    taken[a:b] = b"\1" * (b - a)
                    added.append((kind, a, b))
        return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


@functools.cache
def redactor() -> Redactor:
    return Redactor()


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id, base_spans, spans (strings kind:start:end, comma-joined), n_email, n_ip, n_card, n_phone (of the base spans) and n_added."""
    model = redactor()
    cols = [f"n_{k}" for k in BASE]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf["_text"]:
                base, every = model.spans(t)
                kinds = [k for k, _, _ in base]
                rows.append((*[kinds.count(k) for k in BASE], len(every) - len(base), told(base), told(every)))
            out = pd.DataFrame(rows, columns=[*cols, "n_added", "base_spans", "spans"])
            out.insert(0, "_id", pdf["_id"].to_numpy())
            yield out

    rows = df.select(F.col(id_col).cast("string").alias("_id"), text_or_empty(text_col).alias("_text"))
    got = rows.mapInPandas(run, "_id string, " + ", ".join(f"{c} long" for c in cols) + ", n_added long, base_spans string, spans string")
    return got.select(F.col("_id").cast("long").alias(id_col), *cols, "n_added", "base_spans", "spans")


def redact(text: str, model: Redactor | None = None) -> str:
    """The text with every selected span replaced by its kind in brackets."""
    spans = (model or redactor()).spans(text)[1]
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]
