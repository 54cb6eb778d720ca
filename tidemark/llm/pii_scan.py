"""Personal data in texts: an automaton finds cues, and a parser at each cue finds where the item begins and ends."""

from __future__ import annotations

import ipaddress
import re
import sys
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.batches import map_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mail", "tel", "login", "ip6", "mac", "iban", "account", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
# Lengths of account numbers by country, as registered.
IBAN_LENGTHS = {
    "ad": 24, "ae": 23, "at": 20, "be": 16, "bg": 22, "ch": 21, "cy": 28, "cz": 24, "de": 22, "dk": 18, "ee": 20, "es": 24, "fi": 18,
    "fr": 27, "gb": 22, "gr": 27, "hr": 21, "hu": 28, "ie": 22, "il": 23, "is": 26, "it": 27, "li": 21, "lt": 20, "lu": 20, "lv": 21,
    "mc": 27, "mt": 31, "nl": 18, "no": 15, "pl": 28, "pt": 25, "ro": 24, "sa": 24, "se": 24, "si": 19, "sk": 24, "sm": 27, "tr": 26,
}
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")
SSN_CUES = ("ssn", "social security")
TEL_CUES = ("tel:", "phone:", "fax:", "mobile:")
AT_CUES = ("(at)", "[at]", "{at}")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE_REST = re.compile(r"[\x20().0-9-]+")
WIDE_DOMAIN = re.compile(r"\[(?:[0-9]{1,3}\.){3}[0-9]{1,3}\]|[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
SPELT_DOMAIN = re.compile(r"\x20?([A-Za-z0-9-]+(?:(?:\x20?[\[({]dot[\])}]\x20?|\.)[A-Za-z0-9-]+)*(?:\x20?[\[({]dot[\])}]\x20?|\.)[A-Za-z]{2,})", re.A | re.I)
TEL = re.compile(r"\x20*(\(?[0-9][\x20().0-9-]*[0-9])")
LOGIN = re.compile(r"([^\s/@:?#]+(?::[^\s/@?#]*)?)@[A-Za-z0-9\[]")
COLONS = re.compile(r"[0-9a-f:.]+")
MAC = re.compile(r"[0-9a-f]{2}([:-])(?:[0-9a-f]{2}\1){4}[0-9a-f]{2}(?![0-9a-f:-])")
IBAN = re.compile(r"[a-z]{2}[0-9]{2}(?:\x20?[a-z0-9]){10,30}")
ACCOUNT = re.compile(r"(?:\x20?(?:numbers?|num|nummer|no|nr|n°|#)\.?)?\x20?(?:is\x20|[:=#]\x20?)([0-9](?:[\x20-]?[0-9]){5,16})(?![0-9])")
SSN = re.compile(r"(?:\x20?(?:numbers?|no|nr|#)\.?)?\x20?(?:is\x20|[:=#])?\x20?([0-9]{3})([- ])([0-9]{2})\2([0-9]{4})(?![0-9])")


def _cues() -> dict[str, str]:
    """Every cue, in lower case, with the name of its parser."""
    cues = {"@": "at", "+": "plus", "://": "scheme", "::": "colons"}
    cues |= {d: "digit" for d in "0123456789"}
    cues |= {d + mark: "colons" for d in "0123456789abcdef" for mark in ":"}
    cues |= {f"{a}{b}-": "dashes" for a in "0123456789abcdef" for b in "0123456789abcdef"}
    cues |= {country + d: "iban" for country in IBAN_LENGTHS for d in "0123456789"}
    cues |= dict.fromkeys(ACCOUNT_CUES, "account") | dict.fromkeys(SSN_CUES, "ssn")
    return cues | dict.fromkeys(TEL_CUES, "tel") | dict.fromkeys(AT_CUES, "spelt")


def automaton() -> ahocorasick.Automaton:
    """The automaton of all cues; a match gives the parser's name and the cue's length."""
    cues = ahocorasick.Automaton()
    for cue, parser in _cues().items():
        cues.add_word(cue, (parser, len(cue)))
    cues.make_automaton()
    return cues


def luhn(digits: str) -> bool:
    doubled = (2 * int(d) - 9 * (d > "4") if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return sum(doubled) % 10 == 0


def _apart(text: str, at: int) -> bool:
    """Nothing that belongs to a word stands before ``at``."""
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] == "_")


class Scan:
    """The spans of one text. Each parser is called with the start and end of its cue, from left to right."""

    def __init__(self, text: str, lower: str):
        self.text, self.lower = text, lower
        self.found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
        self.done = dict.fromkeys(("email", "ip", "card", "colons", "dashes", "iban", "login"), 0)

    def at(self, start: int, end: int) -> None:
        """email: the run of mailbox characters before the sign and two or more labels behind it."""
        begin = self.back(start, self.done["email"], LOCAL)
        domain = DOMAIN.match(self.text, end)
        if begin < start and domain:
            self.found["email"].append((begin, domain.end()))
            self.done["email"] = domain.end()
            return
        wide = WIDE_DOMAIN.match(self.text, end)  # letters of any script, or a literal address
        while begin and begin > self.done["email"] and (self.text[begin - 1].isalpha() or self.text[begin - 1] in LOCAL):
            begin -= 1
        if wide and begin < start and self.text[begin:start].strip(".") == self.text[begin:start]:
            self.found["mail"].append((begin, wide.end()))

    def spelt(self, start: int, end: int) -> None:
        """mail: a mailbox with its sign, and perhaps its dots, spelt out in brackets."""
        stop = start - (start > 0 and self.text[start - 1] == " ")
        begin = self.back(stop, 0, LOCAL)
        domain = SPELT_DOMAIN.match(self.text, end)
        if begin < stop and domain:
            self.found["mail"].append((begin, domain.end(1)))

    def back(self, at: int, least: int, allowed: frozenset) -> int:
        while at > least and self.text[at - 1] in allowed:
            at -= 1
        return at

    def digit(self, start: int, end: int) -> None:
        """ip: four parts of a dotted chain at a time. card: a whole chain of digits."""
        text = self.text
        if start >= self.done["ip"]:
            stop = self.done["ip"] = QUAD.match(text, start).end()
            parts = text[start:stop].split(".") if "." in text[start:stop] else []
            begin = start
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                after = begin + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    self.found["ip"].append((begin, after))
                begin = after + 1
        if start >= self.done["card"]:
            chain = CHAIN.match(text, start)
            self.done["card"] = chain.end() if chain else end
            if chain and chain.end() - start >= 16:
                digits = chain[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.found["card"].append(chain.span())

    def plus(self, start: int, end: int) -> None:
        """phone: from the sign to the last digit of the characters that numbers are written with."""
        if self.text[end : end + 1] not in DIGITS:
            return
        rest = PHONE_REST.match(self.text, end + 1)
        last = rest and len(rest[0].rstrip(" ().-"))
        if last and last >= 2:
            stop = end + 1 + last
            if 8 <= sum(c in DIGITS for c in self.text[start:stop]) <= 15:
                self.found["phone"].append((start, stop))

    def tel(self, start: int, end: int) -> None:
        """tel: a number without a plus sign behind a name that announces one."""
        number = TEL.match(self.text, end)
        if number and _apart(self.text, start) and 7 <= sum(c in DIGITS for c in number[1]) <= 15:
            self.found["tel"].append(number.span(1))

    def scheme(self, start: int, end: int) -> None:
        """login: the user, and perhaps the password, before the host of an address."""
        if start and self.text[start - 1].isalnum() and end >= self.done["login"]:
            user = LOGIN.match(self.text, end, end + 400)
            if user:
                self.found["login"].append(user.span(1))
                self.done["login"] = user.end(1)

    def colons(self, start: int, end: int) -> None:
        """ip6, mac: the whole run of hexadecimal digits and colons around the cue."""
        if start < self.done["colons"]:
            return
        begin = self.back(start, self.done["colons"], frozenset("0123456789abcdefABCDEF:"))
        run = COLONS.match(self.lower, begin)
        self.done["colons"] = run.end() if run else end
        if not run or not _apart(self.text, begin) or self.text[run.end() : run.end() + 1].isalnum():
            return
        value = run[0].rstrip(".:") if not run[0].endswith("::") else run[0]
        if MAC.fullmatch(value):
            self.found["mac"].append((begin, begin + len(value)))
        elif value.count(":") >= 2 and len(value) > 2 and len(value) <= 45 and any(c in DIGITS for c in value):
            try:
                ipaddress.IPv6Address(value)
            except ValueError:
                return
            self.found["ip6"].append((begin, begin + len(value)))

    def dashes(self, start: int, end: int) -> None:
        """mac: six pairs with dashes."""
        pairs = MAC.match(self.lower, start) if start >= self.done["dashes"] and _apart(self.text, start) else None
        if pairs and not (start and self.text[start - 1] == "-"):
            self.found["mac"].append(pairs.span())
            self.done["dashes"] = pairs.end()

    def iban(self, start: int, end: int) -> None:
        """iban: as many characters as the country's numbers have, with the right check digits."""
        if start < self.done["iban"] or not _apart(self.text, start):
            return
        run, wanted = IBAN.match(self.lower, start), IBAN_LENGTHS[self.lower[start : start + 2]]
        seen = 0
        for i, c in enumerate(run[0] if run else ""):
            seen += c != " "
            if seen == wanted and not self.text[start + i + 1 : start + i + 2].isalnum():
                value = run[0][: i + 1].replace(" ", "")
                if int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
                    self.found["iban"].append((start, start + i + 1))
                    self.done["iban"] = start + i + 1
                return

    def account(self, start: int, end: int) -> None:
        """account: six to seventeen digits behind the word for an account."""
        number = ACCOUNT.match(self.lower, end)
        if number and _apart(self.text, start):
            self.found["account"].append(number.span(1))

    def ssn(self, start: int, end: int) -> None:
        """ssn: three, two and four digits behind their name, none of the blocks all zeros."""
        number = SSN.match(self.lower, end)
        if number and _apart(self.text, start) and number[1] not in ("000", "666") and number[1] < "900" and number[3] != "00" and number[4] != "0000":
            self.found["ssn"].append((number.start(1), number.end(4)))

    def spans(self) -> list[tuple[str, int, int]]:
        """By kind as listed, then start."""
        return [(kind, *span) for kind in KINDS for span in sorted(set(self.found[kind]))]


def find_spans(text: str, cues: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # only A-Z, so that no length changes
    scan: Scan | None = None
    parsers: dict[str, Callable[[int, int], None]] = {}
    for last, (name, length) in cues.iter(lower):
        if scan is None:
            scan = Scan(text, lower)
            parsers = {n: getattr(scan, n) for n in {n for n, _ in cues.values()}}
        parsers[name](last + 1 - length, last + 1)
    return scan.spans() if scan else []


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (kind, start, end; code points, end exclusive) per row of ``docs``, whole texts.

    An Aho-Corasick automaton finds at-signs, schemes, digits, plus signs and the names of identifiers in one
    pass; at each of them a parser expands to the left and right and validates what it finds.

    Base kinds: ``email``, ``ip`` (parts up to 255), ``card`` (16 to 19 digits, Luhn), ``phone`` (plus sign, 8 to 15
    digits). Added: ``mail`` (mailboxes in other scripts, at literal addresses, or spelt out), ``tel`` (numbers behind
    their name), ``login`` (users in addresses), ``ip6``, ``mac``, ``iban`` (country's length and check digits),
    ``account``, ``ssn``. Spans of one kind do not overlap, those of two may.

    Null and empty texts have no spans. Repeated rows give repeated rows, null ids stay null, other columns are ignored.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    built: list[ahocorasick.Automaton] = []

    def scan(texts: pa.StringArray) -> list:
        if not built:
            built.append(automaton())
        found = (find_spans(t, built[0]) for t in texts.to_pylist())
        return [[[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]]

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return map_texts(rows, "_text", scan, [T.StructField("spans", T.ArrayType(span))])


def joined(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
