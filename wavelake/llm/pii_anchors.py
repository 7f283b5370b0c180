"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier cues. At each
anchor a local parser reads to both sides, finds the boundaries of an e-mail address, IP address, card or phone
number, address with a scheme, or account number, and validates it.

The four base kinds follow fixed grammars, leftmost and without overlaps inside a kind; matches that fail their
check are dropped and not tried again:
  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
  card   [0-9]([\\x20-]?[0-9])+, 14 to 19 digits that pass Luhn's check
  phone  \\+[0-9][\\x20().0-9-]+[0-9], 10 to 15 digits
Three more kinds are added: uri (mailto:, tel: and sip: addresses, and http(s) and ftp addresses with user data
before an at-sign) and account (a cue such as IBAN or account number, then an identifier of 6 to 34 letters
and digits with at least 5 digits; IBANs must pass their check digits), and secret: what a cue such as token, api
key or secret assigns with an equals sign or colon, if it has 16 characters or more, letters and digits; the
same for passwords from 8 characters of two classes on; bearer tokens; and private keys in PEM, to their end.

Defined results. A null text counts as empty and has no spans. Offsets count code points, ends are exclusive.
Spans are sorted by start, then by kind as listed above; spans of different kinds may overlap. Texts are read
whole. Repeated rows each give a row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import map_texts

KINDS = ("email", "ip", "card", "phone", "uri", "account", "secret")
BASE = 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGIT = frozenset("0123456789")
DIALLED = frozenset(" ().0123456789-")
SCHEMES = ("mailto:", "tel:", "sip:", "http://", "https://", "ftp://")
CUES = ("iban", "account number", "account no", "acct no", "passport number", "passport no", "social security number", "ssn")
#: Words that name a secret, and those that name a password.
TOKENS = ("token", "secret", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "secret key", "secret_key", "auth key", "auth_key", "private key", "private_key", "client_secret", "credential", "credentials")
PASSWORDS = ("password", "passwd", "passphrase", "pwd")
PEM = "-----BEGIN "
_ASSIGNED = re.compile(r"[\"'`\])]{0,2}[ \t]{0,4}(?:=>|:=|==?|:)[ \t]{0,4}[\"'`]?(?=[^\s\"'`<>,;]{8})")
_BEARER = re.compile(r"[ \t]{1,2}([A-Za-z0-9._~+/-]{16,}=*)")
_VALUE = re.compile(r"[^\s\"'`<>,;]*")
_PEM_HEAD = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_PEM_TAIL = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_URI = re.compile(r"[^\s<>\"'`|{}\\^]*")
_BREAKS = {"mailto:": re.compile("[@/?]"), "//": re.compile("[/?#@]")}
_IDENTIFIER = re.compile(r"[ \t]{0,2}(?:is|[.:#=])?[ \t]{0,2}([A-Za-z0-9](?:[ -]?[A-Za-z0-9])*)")


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c if c in "@+" else "0", 1))
    for s in SCHEMES:
        for cased in {s, s.upper(), s.capitalize()}:
            a.add_word(cased, ("scheme", len(s)))
    for s in CUES:
        for cased in {s, s.upper(), s.capitalize(), s.title()}:
            a.add_word(cased, ("cue", len(s)))
    for words, what in ((TOKENS, "token"), (PASSWORDS, "password"), (("bearer",), "bearer")):
        for s in words:
            for cased in {s, s.upper(), s.capitalize(), s.title()}:
                a.add_word(cased, (what, len(s)))
    a.add_word(PEM, ("pem", len(PEM)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return text[:2].isalpha() and text[2:4].isdigit() and 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class _Run:
    """A stretch of a text that several anchors may lie in: its end, and the last places of what their validators ask for.

    What is asked of the rest of the stretch from some place on is answered without reading it again, so the anchors
    of a text take time in proportion to it.
    """

    def __init__(self, text: str, start: int, end: int, trimmed: str):
        self.start, self.end = start, end
        body = text[start:end].rstrip(trimmed)
        self.stop = start + len(body)
        self._last: dict = {}
        self._text, self._body = text, body

    def holds(self, at: int) -> bool:
        return self.start <= at < self.end

    def after(self, at: int, what) -> bool:
        """Whether a character for which `what` holds stands in the stretch at or after a place."""
        if what not in self._last:
            self._last[what] = next((self.start + k for k in range(len(self._body) - 1, -1, -1) if what(self._body[k])), -1)
        return self._last[what] >= at

    def nth_digit_from_end(self, n: int) -> int:
        """Where the n-th digit from the end of the stretch is, or -1."""
        if n not in self._last:
            places = [k for k, c in enumerate(self._body) if c in DIGIT]
            self._last[n] = self.start + places[-n] if len(places) >= n else -1
        return self._last[n]

    def last_of(self, word: str) -> int:
        if word not in self._last:
            at = self._body.rfind(word)
            self._last[word] = self.start + at if at >= 0 else -1
        return self._last[word]


def _no_letter_or_digit(c: str) -> bool:
    return not c.isalnum()


class _Scan:
    """Spans of one text; for each kind, where the last match ended."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.spans: list[tuple[int, int, int]] = []
        self.tail: tuple[int, int] | None = None
        self.email_end = self.phone_end = self.run_end = self.dots_end = self.uri_end = 0
        self.uri = self.value = _Run(text, 0, 0, "")
        self.breaks = {k: (0, -1) for k in _BREAKS}

    def next_break(self, kind: str, at: int) -> int:
        """The first character at or after a place that ends the part before the at-sign, or that is the at-sign."""
        since, found = self.breaks[kind]
        if not since <= at <= found:
            hit = _BREAKS[kind].search(self.text, at)
            found = hit.start() if hit else self.n
            self.breaks[kind] = (at, found)
        return found

    def email(self, at: int) -> None:
        text, start = self.text, at
        while start > self.email_end and text[start - 1] in LOCAL:
            start -= 1
        if start == at:
            return
        end, here, dotted = 0, at + 1, False
        while here < self.n and text[here] in LABEL:
            while here < self.n and text[here] in LABEL:
                here += 1
            if dotted:
                end = here
            dotted = True
            if here < self.n and text[here] == ".":
                here += 1
            else:
                break
        if end:
            self.spans.append((start, 0, end))
            self.email_end = end

    def phone(self, at: int) -> None:
        if at < self.phone_end or at + 1 >= self.n or self.text[at + 1] not in DIGIT:
            return
        text, end = self.text, at + 2
        while end < self.n and text[end] in DIALLED:
            end += 1
        while end > at + 3 and text[end - 1] not in DIGIT:
            end -= 1
        if end <= at + 3:
            return
        self.phone_end = end
        if 10 <= sum(c in DIGIT for c in text[at:end]) <= 15:
            self.spans.append((at, 3, end))

    def digits(self, at: int) -> None:
        text, n = self.text, self.n
        if at >= self.run_end:
            end = at + 1
            while end < n and (text[end] in DIGIT or (text[end] in " -" and end + 1 < n and text[end + 1] in DIGIT)):
                end += 1
            self.run_end = end
            number = text[at:end].replace(" ", "").replace("-", "")
            if 14 <= len(number) <= 19 and luhn(number):
                self.spans.append((at, 2, end))
        if at >= self.dots_end:
            runs, here = [], at
            while True:
                start = here
                while here < n and text[here] in DIGIT:
                    here += 1
                runs.append((start, here))
                if here + 1 < n and text[here] == "." and text[here + 1] in DIGIT:
                    here += 1
                else:
                    break
            self.dots_end = here
            for i in range(0, len(runs) - 3, 4):
                if all(len(part := text[a:b].lstrip("0")) <= 3 and int(part or "0") <= 255 for a, b in runs[i : i + 4]):
                    self.spans.append((runs[i][0], 1, runs[i + 3][1]))

    def scheme(self, start: int, here: int) -> None:
        text = self.text
        if start < self.uri_end or (start and text[start - 1].isalnum()):
            return
        if not self.uri.holds(here):
            self.uri = _Run(text, here, _URI.match(text, here).end(), ".,;:!?)]")
        stop, head = self.uri.stop, text[start:here].lower()
        if head == "tel:":
            good = self.uri.nth_digit_from_end(7) >= here
        else:
            kind = "mailto:" if head in ("mailto:", "sip:") else "//"
            at = self.next_break(kind, here)
            good = here < at < stop - 1 and text[at] == "@" and not _BREAKS[kind].match(text, at + 1)
        if good:
            self.uri_end = stop
            self.spans.append((start, 4, stop))

    def cue(self, start: int, here: int) -> None:
        text = self.text
        if (start and text[start - 1].isalnum()) or (here < self.n and text[here].isalnum()):
            return
        found = _IDENTIFIER.match(text, here, min(self.n, here + 64))
        if not found:
            return
        if text[start:here].lower() == "iban":
            plain, places = "", []
            for i in range(*found.span(1)):
                if text[i].isalnum():
                    plain += text[i].upper()
                    places.append(i + 1)
            sizes = [k for k in range(min(34, len(plain)), 14, -1) if iban(plain[:k])]
            if sizes:
                self.spans.append((found.start(1), 5, places[sizes[0] - 1]))
            return
        first = re.match(r"[A-Za-z0-9-]+", text[found.start(1) : found.end(1)])[0].rstrip("-")
        if 6 <= len(first.replace("-", "")) <= 34 and sum(c in DIGIT for c in first) >= 5:
            self.spans.append((found.start(1), 5, found.start(1) + len(first)))


    def secret(self, what: str, start: int, here: int) -> None:
        text = self.text
        if (start and text[start - 1].isalnum()) or (here < self.n and text[here].isalnum()):
            return
        if what == "bearer":
            found = _BEARER.match(text, here)
            if not found:
                return
            at = found.start(1)
            run = _Run(text, at, found.end(1), ".:!?)]}")
        else:
            found = _ASSIGNED.match(text, here)
            if not found:
                return
            at = found.end()
            if not self.value.holds(at):
                self.value = _Run(text, at, _VALUE.match(text, at).end(), ".:!?)]}")
            run = self.value
        size = run.stop - at
        digit, lower, upper = (run.after(at, f) for f in (str.isdigit, str.islower, str.isupper))
        if what == "password":
            good = size >= 8 and digit + lower + upper + run.after(at, _no_letter_or_digit) >= 2
        else:
            good = size >= 16 and digit and (lower or upper)
        if good and run.last_of("://") < at:
            self.spans.append((at, 6, run.stop))

    def pem(self, start: int) -> None:
        if head := _PEM_HEAD.match(self.text, start):
            if self.tail is None or self.tail[0] < head.end():
                tail = _PEM_TAIL.search(self.text, head.end())
                self.tail = tail.span() if tail else (self.n, 0)
            self.spans.append((start, 6, max(head.end(), self.tail[1])))


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span of a text."""
    scan = _Scan(text)
    for last, (what, size) in automaton().iter(text):
        if what == "0":
            if last >= scan.run_end or last >= scan.dots_end:
                scan.digits(last)
        elif what == "@":
            scan.email(last)
        elif what == "+":
            scan.phone(last)
        elif what == "scheme":
            scan.scheme(last + 1 - size, last + 1)
        elif what == "cue":
            scan.cue(last + 1 - size, last + 1)
        elif what == "pem":
            scan.pem(last + 1 - size)
        else:
            scan.secret(what, last + 1 - size, last + 1)
    return [(KINDS[k], a, b) for a, k, b in sorted(set(scan.spans))]


def _rows(keys: list, texts: list[str]) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": keys} | {f"n_{k}": [] for k in KINDS[:BASE]} | {"base_sha256": [], "spans": []} | {f"n_{k}": [] for k in KINDS[BASE:]} | {"n_spans": []}
    for text in texts:
        spans = find(text)
        out["n_spans"].append(len(spans))
        for k in KINDS:
            out[f"n_{k}"].append(sum(s[0] == k for s in spans))
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in KINDS[:BASE])
        out["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
        out["spans"].append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    return out


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and counts of the other kinds and of all; nothing is shuffled."""
    return map_texts(docs.select(F.col(doc_id).cast("bigint"), F.col(text)), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_uri bigint, n_account bigint, n_secret bigint, n_spans bigint", _rows)
