"""Personal data and secrets: candidate spans judged by boosted trees.

Generators propose spans, far more than are personal and partly overlapping.
Each span gets features of its format (digits, separators, check sums, entropy)
and of its context (neighbouring characters, hint words before it).  Gradient
boosted trees, trained here on generated examples with known answers, give each
span a score; scores are calibrated on examples of their own, and each kind's
threshold is the lowest that keeps the wanted precision on a third set.  Spans above their
thresholds that overlap are joined, so that no part of one stays, and replaced by
<KIND> of the most certain.
"""

from __future__ import annotations

import ipaddress
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textcore
from .cluster import docs_of, need

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "secret")
_LOCAL = r"\s@<>()\[\]\",;:|"
_EMAIL = re.compile(rf"(?<![^{_LOCAL}])[^{_LOCAL}]+@[\w-]+(?:\.[\w-]+)+")
_IP4 = re.compile(r"(?<!\d)\d{1,3}(?:\.\d{1,3}){3}(?!\d)")
_IP6 = re.compile(r"(?<![\w:])[0-9A-Fa-f:]{2,}(?:(?<=:)\d{1,3}(?:\.\d{1,3}){3})?(?![\w:])")
#: Digit groups with up to two separators between them.
_NUMBERS = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}\d+(?:[ .\-/()]{1,2}\d+)*")
_DIGITS = re.compile(r"\d+")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
_TOLD_SECRET = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|passwort|kennwort|contrase[nñ]a|mot de passe|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|bearer)s?[\"']?\s*(?:[:=]|is)?\s*[\"']?([^\s\"'<>]{6,})")
_BARE_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*\d)[A-Za-z0-9+/_=-]{20,}")
HINTS = (
    re.compile(r"(?i)mail|contact|schreib|correo|courriel"),
    re.compile(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|ruf|llama|appel|whatsapp|sms|handy|dial|ring)"),
    re.compile(r"(?i)\b(?:ip|ipv4|ipv6|host|server|address|addr|ping|from|client|gateway|dns|router|node)\b"),
    re.compile(r"(?i)\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta|cc|payment)"),
    re.compile(r"(?i)\b(?:ssn|social|security|iban|account|konto|cuenta|compte|bank)"),
    re.compile(r"(?i)(?:token|secret|passw|pwd|key|auth|credential|bearer|passphrase|kennwort|contrase|mot de passe|login)"),
    re.compile(r"(?i)\b(?:versions?|release|v|chapters?|sections?|sect|pages?|isbn|issn|ean|orders?|invoices?|items?|no|nr|ref|figure|table|build|id|sha|commit|hash|doi|date|years?|since|ratio|total|rows)\b[^\w]{0,3}\w{0,3}[^\w]{0,2}$|[$€£] ?$"),
)
TOLD = 48


def _luhn(d: str) -> bool:
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ip6_ok(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return any(c not in ":0" for c in s)


def _number_spans(text: str, out: dict) -> None:
    """Of each run of digit groups: every stretch of whole groups whose digits and separators fit a kind."""
    for m in _NUMBERS.finditer(text):
        groups = [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())]
        size = [y - x for x, y in groups]
        for i, (x, _) in enumerate(groups):
            begin = x
            while begin > m.start() and text[begin - 1] in "+(":
                begin -= 1
            plus = "+" in text[begin:x]
            total, seps = 0, set()
            for j in range(i, len(groups)):
                total += size[j]
                if total > 19:
                    break
                if j > i:
                    seps.add(text[groups[j - 1][1] : groups[j][0]])
                end, n = groups[j][1], j - i + 1
                own = size[i : j + 1]
                if total >= 12 and (not seps or seps in ({" "}, {"-"})):
                    out[x, end, "card"] = None
                if own == [3, 2, 4] and seps <= {"-", " "}:
                    out[x, end, "ssn"] = None
                if 7 <= total <= 15 and (
                    plus and n <= 7
                    or n == 1 and total >= 9
                    or 2 <= n <= 6 and total <= 13 and (2 <= own[0] <= 5 or size[i] == 1) and all(2 <= k <= (8 if n == 2 else 5) for k in own[1:])
                ):
                    out[begin, end, "phone"] = None


def candidates(text: str) -> list[tuple[int, int, str]]:
    """All proposed spans: begin, end, kind.  They overlap, within a kind too: a value after another number, or after a name and =, is proposed without it as well."""
    out: dict[tuple[int, int, str], None] = {}

    def add(a: int, b: int, kind: str) -> None:
        while b > a and text[b - 1] in ".,;:!?)]}'\"":
            b -= 1
        if b > a:
            out[a, b, kind] = None

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(*m.span(), "email")
            at = m.group().rindex("@")
            if cut := max(m.group().rfind(c, 0, at) for c in "=/'&?{}*~") + 1:
                add(m.start() + cut, m.end(), "email")
    for m in _IP4.finditer(text):
        add(*m.span(), "ip")
    if ":" in text:
        for m in _IP6.finditer(text):
            if m.group().count(":") > 1:
                a, b = m.span()
                out[a, b - (text[b - 1] == ":" and text[b - 2] != ":"), "ip"] = None
    _number_spans(text, out)
    for m in _IBAN.finditer(text):
        add(*m.span(), "iban")
        # words after a number may look like more of it
        for g in re.finditer(r"(?= |$)", m.group()):
            if g.start() >= 15 and _iban_ok(m.group()[: g.start()]):
                add(m.start(), m.start() + g.start(), "iban")
    for m in _TOLD_SECRET.finditer(text):
        add(*m.span(1), "secret")
    for m in _BARE_SECRET.finditer(text):
        add(*m.span(), "secret")
    return sorted(out)


_YEARS = re.compile(r"(?:19|20)\d{2}[-./ ]\d{1,2}[-./ ]\d{1,2}|\d{1,2}[-./ ]\d{1,2}[-./ ](?:19|20)\d{2}|(?:1[5-9]|20)\d{2}[-/ ](?:1[5-9]|20)\d{2}")
#: Formats with a meaning of their own: ten digits as in North America, and what issued keys begin with.
_TEN = re.compile(r"(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}")
_ISSUED = re.compile(r"(?:AKIA|ASIA|AROA|AIza|gh[a-z]_|sk-|pk-|xox[a-z]-|eyJ|glpat-|npm_)")
_PARTS, _RUNS = re.compile(r"[ .()/-]+"), re.compile(r"\D+")


def features(text: str, a: int, b: int, kind: str) -> list[float]:
    """Format and context of a span."""
    s = text[a:b]
    n = b - a
    digits = "".join(c for c in s if c in "0123456789")
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    near, behind = text[max(0, a - 2) : a], text[b : b + 2]
    told = text[max(0, a - TOLD) : a]
    octets = s.split(".") if kind == "ip" else []
    ip_ok = len(octets) == 4 and all(o.isdigit() and int(o) < 256 and str(int(o)) == o for o in octets)
    tail = s.rsplit(".", 1)[-1] if kind == "email" else ""
    upper, lower = sum(c.isupper() for c in s), sum(c.islower() for c in s)
    hexa = sum(c in "0123456789abcdefABCDEF" for c in s)
    parts = [x for x in _PARTS.split(s) if x]
    runs = [len(x) for x in _RUNS.split(s) if x]
    return [
        *(float(kind == k) for k in KINDS), n, len(digits), len(digits) / n, letters / n, len(counts) / n, entropy,
        sum(c in " .-" for c in s), float(len(digits) in (15, 16)), float(bool(digits) and len(digits) >= 12 and _luhn(digits)),
        float(ip_ok), float(sum(int(o) < 16 for o in octets) if ip_ok else 0), float(ip_ok and (octets[0] in ("10", "127") or octets[:2] == ["192", "168"] or octets[0] == "172" and 16 <= int(octets[1]) < 32)),
        float(kind == "ip" and ":" in s and _ip6_ok(s)), float(s[0] == "+"), float("(" in s), float(s[0] == "0" or s[:2] == "(0"),
        float(tail.isalpha() and 2 <= len(tail) <= 12), float(kind == "iban" and _iban_ok(s)), float(before.isalnum()), float(after.isalnum()),
        float(before in "\"'"), float(":" in near or "=" in near), float(before in ".-/,#_"), float(after in "-/_%"), float(after == "." and b + 1 < len(text) and text[b + 1].isdigit()),
        float(before in " .-/" and near[:1].isdigit()), float(behind[:1] in (" ", ".", "-", "/", ",") and behind[1:].isdigit()),
        upper / n, lower / n, hexa / n, float(sum(not c.isalnum() for c in s)), float(sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))), float(sum(c in "aeiouAEIOU" for c in s) / max(1, letters)),
        float(bool(_YEARS.fullmatch(s))), float(kind == "phone" and bool(_TEN.fullmatch(s))), float(kind == "secret" and bool(_ISSUED.match(s))), float(len(parts)), float(len(runs)), float(max(runs, default=0)), float(min(runs, default=0)), float(len(parts[0]) if parts else 0), float(len(parts[-1]) if parts else 0), *(float(bool(h.search(told))) for h in HINTS),
    ]


# ---- examples with known answers


def _examples(n: int, seed: int) -> list[tuple[str, int, int, str, int]]:
    """Texts with a value each: text, begin, end and kind of a candidate in it, 1 if that is personal.

    Candidates that share a part with a personal value, but aren't it, are left out.
    """
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]
    dig = lambda k: "".join(str(x) for x in r.integers(0, 10, k))
    num = lambda k: str(r.integers(1, 10)) + dig(k - 1)
    abc = lambda k, s="abcdefghijklmnopqrstuvwxyz": "".join(pick(s) for _ in range(k))
    word = lambda: "".join(abc(1, "bcdfghklmnprstvw") + abc(1, "aeiou") for _ in range(int(r.integers(1, 5)))) + pick(("", "n", "r", "s", "t"))
    words = lambda k: " ".join(word() for _ in range(k))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alnum = upper.lower() + upper + "0123456789"
    oct_ = lambda lo=0, hi=256: str(r.integers(lo, hi))
    hexs = lambda k: abc(k, "0123456789abcdef")

    def iban() -> str:
        c, x = pick((("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14), ("PL", 24), ("IT", 23)))
        x = abc(4, upper) + dig(x - 4) if c in ("GB", "NL") else dig(x)
        check = 98 - int("".join(str(int(k, 36)) for k in x + c + "00")) % 97
        s = f"{c}{check:02d}{x}"
        return pick((s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))))

    def card() -> str:
        d = pick((lambda: "4" + dig(14), lambda: "5" + dig(14), lambda: "6011" + dig(11), lambda: pick(("34", "37")) + dig(12)))()
        d += next(c for c in "0123456789" if _luhn(d + c))
        if r.random() < 0.25:
            d = dig(16)  # as they are made up in texts
        return pick((d, d, "-".join(d[i : i + 4] for i in range(0, len(d), 4)), " ".join(d[i : i + 4] for i in range(0, len(d), 4))) if len(d) == 16 else (d, f"{d[:4]} {d[4:10]} {d[10:]}"))

    def ip6() -> str:
        g = [f"{int(x):x}" for x in r.integers(0, 65536, 8)]
        if r.random() < 0.6:
            at = int(r.integers(0, 6))
            return ":".join(g[:at]) + "::" + ":".join(g[at + 2 :][: int(r.integers(1, 5))])
        return ":".join(x.zfill(4) for x in g)

    special = "!#$%&*+-_?@."
    password = lambda: pick((
        lambda: word() + dig(int(r.integers(1, 5))), lambda: word() + dig(1) + word() + dig(1), lambda: word().title() + pick(special) + dig(int(r.integers(2, 5))), lambda: abc(int(r.integers(8, 20)), alnum + special), lambda: (w := word() + dig(1)) + w, lambda: word() + pick(special) + word() + dig(2),
    ))().ljust(8, "7")
    sep = lambda *x: pick((" ", "-", ".", "")).join(x)
    positive = {
        "email": (
            lambda: f"{pick((word(), word() + pick('._-') + word(), word() + dig(2), abc(1) + '.' + word(), word() + '.' + dig(2), word() + '+' + word(), 'é' + word() + '.' + dig(2), word() + word() + '.' + word() + word() + word()))}@{pick((word(), word() + '-' + word(), 'mail' + dig(1), word() + dig(1)))}.{pick(('com', 'org', 'net', 'example.com', 'co.uk', 'de', 'fr', 'es', 'io', 'edu', 'gov', 'museum'))}",
        ),
        "phone": (
            lambda: f"+{pick(('1', '44', '49', '33', '34'))} ({dig(3)}) {dig(3)}-{dig(4)}", lambda: f"({dig(3)}) {dig(3)}-{dig(4)}", lambda: f"{num(3)}-{dig(3)}-{dig(4)}", lambda: f"{num(3)}.{dig(3)}.{dig(4)}", lambda: f"1-{num(3)}-{dig(3)}-{dig(4)}",
            lambda: f"+{pick(('44', '49', '33', '34', '48', '351'))} {dig(int(r.integers(1, 4)))} {dig(3)} {dig(4)}", lambda: f"+{num(2)}{dig(9)}", lambda: f"+33 {num(1)} {dig(2)} {dig(2)} {dig(2)} {dig(2)}", lambda: f"+{pick(('34', '48'))} {num(3)} {dig(3)} {dig(3)}",
            lambda: f"0{num(3)} {dig(3)} {dig(4)}", lambda: f"0{num(2)}{pick('/ -')}{num(int(r.integers(6, 9)))}", lambda: sep("0" + num(1), dig(2), dig(2), dig(2), dig(2)), lambda: f"0{num(4)} {dig(6)}", lambda: f"(0{num(2)}) {dig(3)} {dig(int(r.integers(2, 5)))}", lambda: f"0{num(int(r.integers(9, 12)))}",
        ),
        "ip": (
            lambda: ".".join((oct_(1), oct_(), oct_(), oct_(1))), lambda: ".".join((oct_(20, 224), oct_(), oct_(), oct_(1))), ip6, lambda: f"192.168.{oct_()}.{oct_()}", lambda: f"192.168.{oct_(0, 4)}.{oct_(1, 30)}", lambda: f"10.{oct_(0, 30)}.{oct_(0, 30)}.{oct_(1)}", lambda: f"10.0.{oct_(0, 4)}.{oct_(1, 60)}", lambda: f"172.{oct_(16, 32)}.{oct_(0, 9)}.{oct_(1)}",
        ),
        "card": (card,),
        "ssn": (lambda: f"{dig(3)}-{dig(2)}-{dig(4)}",),
        "iban": (iban,),
        "secret": (
            lambda: hexs(40), lambda: hexs(40).upper(), lambda: hexs(32), lambda: hexs(64), lambda: pick(("AKIA", "ASIA")) + abc(16, upper + "234567"), lambda: pick(("AKIA", "ASIA", "AROA")) + abc(int(k := r.integers(4, 14)), upper) + dig(1) + abc(15 - int(k), upper), lambda: abc(20, upper + "0123456789"), lambda: "ghp_" + abc(36, alnum), lambda: "sk-" + abc(44, alnum), lambda: "xoxb-" + dig(11) + "-" + abc(24, alnum), lambda: abc(int(r.integers(24, 64)), alnum), lambda: abc(int(r.integers(30, 60)), alnum + "+/") + "=",
        ),
    }
    told = {
        "email": ("mail ", "contact ", "write to ", "email=", "mailto:", "user=", "", "", ""),
        "phone": ("call ", "tel. ", "phone: ", "mobile ", "fax ", "ring ", "Tel.: ", "call ", "", "", "12 ", "entry 305 ", "no. 7 "),
        "ip": ("from ", "ip ", "host ", "server ", "at ", "client ", "connect to ", "", "", ""),
        "card": ("card ", "visa ", "paid with ", "room 12 ", "card no. 2: ", "", "", ""), "ssn": ("SSN ", "social security ", "", "no. 7 "), "iban": ("IBAN ", "account ", "", "", "to 2 "),
        "secret": ("token = \"", "api_key: ", "password=", "secret = '", "TOKEN = \"", "auth ", "key ", "bearer ", "export KEY=", "", "", ""),
    }
    national = ("call ", "tel. ", "phone: ", "mobile ", "fax ", "Tel.: ", "Handy ", "dial ", "ring me at ", "ID 1042 call ")
    negative = {
        "email": (lambda: ("@", f"{word()}@{word()}.{dig(2)}"), lambda: ("", f"x@{dig(1)}.{dig(1)}"), lambda: ("", f"{word()}@{num(1)}.{dig(1)}.{dig(1)}")),
        "phone": (
            lambda: (pick(("on ", "date ", "")), f"20{dig(2)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}{pick(('', f' {r.integers(0, 24):02d}:{dig(2)}:{dig(2)}'))}"), lambda: (pick(("", "since ", "in ")), f"{r.integers(1500, 2030)}-{r.integers(1500, 2030)}"), lambda: ("", f"{r.integers(1, 29):02d}.{r.integers(1, 13):02d}.{r.integers(1900, 2030)}"),
            lambda: (pick(("order ", "invoice no. ", "ISBN ", "id ", "ref ")), dig(int(r.integers(6, 13)))), lambda: ("", num(int(r.integers(4, 13)))), lambda: ("", f"{dig(2)}.{dig(2)}"), lambda: (pick(("$", "€", "", "about ")), f"{num(int(r.integers(1, 4)))} {dig(3)} {dig(3)}"), lambda: ("", f"{num(3)} {dig(3)} {dig(3)}"),
            lambda: ("pages ", f"{dig(3)}-{dig(3)}"), lambda: ("version ", f"{dig(2)}.{dig(2)}.{dig(3)}"), lambda: ("", f"{num(4)}.{dig(4)}"), lambda: ("", str(r.integers(10**9, 2 * 10**9))), lambda: (pick(("", "in ", "rows ")), " ".join(num(int(r.integers(1, 5))) for _ in range(int(r.integers(3, 12))))), lambda: ("at ", f"{num(2)}.{dig(4)} {num(2)}.{dig(4)}"),
            lambda: ("", f"{num(3)}/{num(4)}"), lambda: ("ISBN ", f"978-{num(1)}-{dig(2)}-{dig(6)}-{dig(1)}"), lambda: ("", f"{num(4)} {num(4)}"), lambda: ("", f"{num(3)}-{num(4)}"), lambda: ("of ", f"{num(2)} {num(2)} {num(2)} {num(2)}"),
        ),
        "ip": (
            lambda: (pick(("version ", "v", "release ", "build ", "section ", "chapter ")), ".".join((oct_(0, 12), oct_(0, 20), oct_(0, 30), oct_(0, 12)))), lambda: (pick(("version ", "v", "section ", "")), ".".join(oct_(0, 10) for _ in range(4))), lambda: (pick(("version ", "release ")), ".".join((oct_(0, 100), oct_(0, 100), oct_(), oct_()))),
            lambda: ("", ".".join((oct_(256, 999), oct_(), oct_(256, 999), oct_()))), lambda: ("at ", ":".join(f"{r.integers(0, 60):02d}" for _ in range(int(r.integers(3, 5))))), lambda: (pick(("", "ratio ")), ":".join(num(1) for _ in range(3))), lambda: ("", f"{word()}::{word()}"), lambda: ("", pick(("::", ":::", "a::b", "dead:beef")))),
        "card": (
            lambda: (pick(("ISBN ", "EAN ", "order ", "id ", "invoice ", "ref ")), dig(int(r.integers(12, 15)))), lambda: (pick(("order no. ", "sha ", "build ", "order ")), dig(17)), lambda: ("", dig(12)), lambda: ("", dig(13)), lambda: ("", dig(19)), lambda: ("", " ".join(dig(2) for _ in range(7))), lambda: ("", " ".join(num(3) for _ in range(int(r.integers(4, 9))))), lambda: ("", f"{dig(14)}"), lambda: ("", " ".join(str(r.integers(1900, 2030)) for _ in range(int(r.integers(3, 8))))),
        ),
        "ssn": (lambda: ("pages ", f"{dig(3)} {dig(2)} {dig(4)}"), lambda: ("item ", f"{dig(3)} {dig(2)} {dig(4)}"), lambda: ("", f"{dig(3)} {dig(2)} {dig(4)} {dig(3)}")),
        "iban": (lambda: (pick(("item ", "ref ", "")), f"{abc(2, 'ABCDEFGHIJKLMNOP')}{dig(2)} {dig(4)} {dig(4)}"), lambda: ("", f"{abc(2, 'ABCDEFGH')}{dig(2)}{abc(8, 'ABCDEFGHIJ')}"), lambda: ("", f"{abc(2, 'ABCDEFGH')}{dig(20)}")),
        "secret": (
            lambda: (pick(("token ", "secret ", "key ", "password ", "passwords ", "the secret is ", "author ", "authority ", "Token: ", "tokens: ")), word() + word()), lambda: (pick(("secret of ", "password for ", "key ")), words(3)), lambda: ("", abc(12) + "-" + abc(8) + "-" + dig(2)), lambda: ("", "/" + word() + "/" + word() + "/" + dig(4) + "/" + word() + "/" + word()), lambda: ("", "-" * 22 + dig(1)),
            lambda: ("", "_".join(word() for _ in range(4)) + dig(1)), lambda: ("", "-".join(word() for _ in range(5)) + "-" + dig(2)), lambda: ("", "=" * 24 + dig(2)), lambda: ("", dig(int(r.integers(20, 30)))), lambda: ("", abc(24) + dig(1)), lambda: (pick(("commit ", "sha ", "hash ")), hexs(40)), lambda: ("", word() + word() + word() + word() + word() + word() + dig(4)),
            lambda: ("", f"{dig(4)}-{dig(2)}-{dig(2)}-{word()}-{word()}-{word()}"), lambda: ("", upper + dig(1)), lambda: (pick(("password: ", "token = ", "password=")), pick(("required", "optional", "string", "forgotten", "undefined", "your_password", "changing", "********"))),
        ),
    }
    out = []
    for _ in range(n):
        kind = pick(KINDS)
        is_personal = r.random() < 0.5
        if is_personal:
            lead, s = pick(told[kind]), pick(positive[kind])()
            if kind == "phone" and s[:1] in "0(" and not s.startswith("("):
                lead = pick(national)
            elif kind == "secret" and r.random() < 0.35:
                lead, s = pick(("password: ", "password=", "passwd: ", "pwd=", "Password is ", "passphrase: ", "login password: ", "Passwort: ", "password \"")), password()
        else:
            lead, s = pick(negative[kind])()
        end = pick((" ", " ", ". ", ", ", ".\n", '" ')) if '"' not in lead else '" '
        text = f"{words(int(r.integers(0, 12)))} {lead}{s}{end}{words(int(r.integers(0, 8)))}"
        if r.random() < 0.1 and kind != "secret":
            text = text.upper()
            s = s.upper()
        a = text.find(s, len(text) - len(text.lstrip()))
        b = a + len(s)
        for x, y, k in candidates(text):
            if not is_personal or y <= a or b <= x:
                out.append((text, x, y, k, 0))
            elif (x, y) == (a, b):
                # a span proposed as another kind isn't that
                out.append((text, x, y, k, int(k == kind)))
    return out


# ---- boosted trees


class Trees:
    """Gradient boosting of log-loss with trees of depth 3 over quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        q = self._binned(x)
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base, self.trees = math.log(p / (1 - p)), []
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins + 1, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                best = np.full(2**level, 1e-6)
                for j in range(x.shape[1]):
                    nb = len(self.cuts[j]) + 1
                    key = (node - first) * nb + q[:, j]
                    sg = np.bincount(key, weights=g, minlength=2**level * nb).reshape(-1, nb)
                    sh = np.bincount(key, weights=h, minlength=2**level * nb).reshape(-1, nb)
                    lg, lh = sg.cumsum(axis=1), sh.cumsum(axis=1)
                    tg, th = lg[:, -1:], lh[:, -1:]
                    gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                    k = gain.argmax(axis=1)
                    top = gain[np.arange(len(k)), k]
                    better = top > best
                    best = np.where(better, top, best)
                    feature[first : first + 2**level][better] = j
                    cut[first : first + 2**level][better] = k[better]
                node = 2 * node + 1 + (q[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, weights=g, minlength=2**self.depth) / (np.bincount(leaf, weights=h, minlength=2**self.depth) + 1)
            self.trees.append((feature, cut, value))
            f += value[leaf]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        q, f, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (q[rows, feature[node]] > cut[node])
            f += value[node - (2**self.depth - 1)]
        return f


def _isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and the rising probabilities that fit y best (pool adjacent violators)."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        pools.append([s, float(v), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            s2, v2, n2 = pools.pop()
            pools[-1][1] += v2
            pools[-1][2] += n2
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Judge:
    """Trees, calibration and thresholds by kind."""

    def __init__(self, trees: Trees, calibration: tuple[np.ndarray, np.ndarray], threshold: dict[str, float]):
        self.trees, self.calibration, self.threshold = trees, calibration, threshold

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        at, p = self.calibration
        return p[np.clip(np.searchsorted(at, margin, side="right") - 1, 0, len(p) - 1)]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.trees.margin(x))

    def accepted(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans to redact of each text, in order, none of which overlap.  All texts are judged at once."""
        found = [(i, *c) for i, text in enumerate(texts) for c in candidates(text)]
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not found:
            return out
        m = self.trees.margin(np.array([features(texts[i], a, b, k) for i, a, b, k in found], np.float32))
        p = self.calibrated(m)
        limit = np.array([self.threshold[k] for *_, k in found])
        surest = lambda n: (round(p[n], 6), found[n][2] - found[n][1], m[n])
        merged: list[list[int]] = []
        for n in np.flatnonzero(p >= limit).tolist():
            i, lo, hi, _ = found[n]
            if merged and merged[-1][0] == i and lo < merged[-1][2]:
                last = merged[-1]
                last[2], last[3] = max(last[2], hi), max(n, last[3], key=surest)
            else:
                merged.append([i, lo, hi, n])
        for i, lo, hi, n in merged:
            out[i].append((lo, hi, found[n][3]))
        return out


@lru_cache(maxsize=4)
def trained(n: int = 14_000, seed: int = 5, precision: float = 0.97) -> Judge:
    """The judge, from n generated texts: half train the trees, a quarter calibrates the scores, a quarter sets the thresholds."""
    rows = _examples(n, seed)
    x, y = np.array([features(*r[:4]) for r in rows], np.float32), np.array([r[4] for r in rows], np.float64)
    # candidates of one text stay together
    text = np.unique([r[0] for r in rows], return_inverse=True)[1] % 4
    trees = Trees().fit(x[text < 2], y[text < 2])
    held, last = text == 2, text == 3
    judge = Judge(trees, _isotonic(trees.margin(x[held]), y[held]), {})
    p, kinds = judge.probability(x[last]), np.array([r[3] for r in rows])[last]
    for k in KINDS:
        pk, yk = p[kinds == k], y[last][kinds == k]
        fits = [t for t in np.unique(pk) if t > 0 and yk[pk >= t].mean() >= precision]
        # halfway to the next lower score that occurs: the same spans of this set, and room for others like them
        below = [t for t in np.unique(pk) if fits and t < min(fits)]
        judge.threshold[k] = float(min(fits) + max(below, default=0.0)) / 2 if fits else 1.1
    return judge


# ---- the operator


def _redacted(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, str]:
    """The text with its spans replaced, and their description."""
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join(out) + text[at:], ";".join(f"{k}:{a}-{b}" for a, b, k in spans)


def redact_column(judge: Judge, column: pa.Array) -> tuple[pa.Array, list[str], list[int]]:
    """Redacted texts (a null stays null), their spans and the number of spans.

    Only texts with a digit, an @, :: or a word such as 'password' are looked at: no generator finds anything in others.
    """
    look = pc.fill_null(pc.match_substring_regex(column, r"[0-9@]|::|(?i:pass|token|secret|key|auth|credential|bearer|pwd|kennwort|contrase)"), False)
    spans, counts, texts = [""] * len(column), [0] * len(column), None
    some = np.flatnonzero(np.asarray(look)).tolist()
    own = column.take(pa.array(some, pa.int64())).to_pylist()
    for i, text, found in zip(some, own, judge.accepted(own)):
        if found:
            if texts is None:
                texts = column.to_pylist()
            counts[i] = len(found)
            texts[i], spans[i] = _redacted(text, found)
    return (column if texts is None else pa.array(texts, column.type)), spans, counts


def _find(judge: Judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textcore.pieces(batch, "text"):
                text, spans, counts = redact_column(judge, b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int32()), pa.array(spans, pa.string()), text], ["doc_id", "n_spans", "spans", "text"])

    return run


def redact(docs: DataFrame, precision: float = 0.97) -> DataFrame:
    """doc_id, n_spans, spans ('kind:begin-end' in characters, by ';') and the redacted text, one row for each row of docs.

    docs: doc_id, text; other columns aren't used.  A null text stays null and an
    empty one empty, without spans.  Null and repeated doc_ids stay as they are.
    Texts are searched to their end.  One pass, without a shuffle.
    """
    return docs_of(docs).mapInArrow(_find(trained(precision=precision)), "doc_id bigint, n_spans int, spans string, text string")


def redacted_docs(docs: DataFrame, precision: float = 0.97) -> DataFrame:
    """docs with redacted texts, and n_chars, where there is such a column, counted again; all other columns stay."""
    need(docs, "text")
    judge = trained(precision=precision)
    count = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in textcore.pieces(batch, "text"):
                cols = {n: b.column(n) for n in b.schema.names}
                cols["text"], _, _ = redact_column(judge, b.column("text"))
                if count:
                    cols["n_chars"] = pc.if_else(pc.is_valid(cols["text"]), pc.utf8_length(cols["text"]).cast(b.schema.field("n_chars").type), cols["n_chars"])
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["redact", "redacted_docs"]
