"""Personal data and secrets, replaced by keyed surrogates.

1. Detection: spans (kind, text) of each document, by format. Names are capitalised words after a title or words that
   introduce a name, two of them before a verb of saying, or a known given name with what follows it; each part of a name
   is an entity of its own, and every later mention of a part in the text is found. Names without any of these are not.
2. Surrogates: every distinct value of a family gets one draw from a stream keyed by (key, kind, value, attempt). All parts of
   names are one family, so that a value has one surrogate in the whole corpus, whatever it was found as; its kinds are folded:
   a given name if it is one anywhere, of the gender found, or of none if both were. The domains of e-mail addresses are a
   family beside the addresses: equal domains stay equal, distinct ones distinct.
   A draw keeps the type's own rules (checksum, octets, country code), every separator, and the script and case of each
   letter. Given names keep their gender: after two draws from the listed names they are made of syllables with an ending
   of their gender, one more syllable every fourth attempt. That holds for Latin, Cyrillic, Greek, Hebrew and Arabic letters;
   in other scripts letters are drawn without gender. From attempt GROWS on surnames, secrets, local parts and domains grow by
   a character every fourth attempt, and octets take any length, so that short values do not run out.
3. Collisions: a draw that equals any value found in the corpus, or that another value drew, is drawn again with the next
   attempt; of several values with one draw the smallest keeps it. So distinct values stay distinct, and equal ones equal.
4. Replacement: the surrogates join the documents' entities and are put in place.

A null text stays null, has no entities and is left alone, as is every text without entities. Texts are read whole, in time
linear in their length. Of overlapping entities the kind that is looked for first stays, in the order secret, e-mail, other
formats, names. Repeated rows are replaced alike. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import _common as C

# ---------------------------------------------------------------- detection
# Given names by gender and titles by gender.
GIVEN = {
    "f": "Anna Maria Emma Sophie Julia Laura Clara Elena Lucia Carmen Isabel Camille Chloe Alice Mary Linda Susan Karen Sarah Jane Olga Irina Elif Aisha".split(),
    "m": "Anton Mario Emil Stefan Julian Lukas Karl Pablo Luis Carlos Diego Pierre Louis Hugo John James Robert David Peter Paul Ivan Boris Mehmet Omar".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Doña".split(), "m": "Mr Herr Monsieur Señor Sr Don".split(), "n": "Dr Prof".split()}
_GENDER = {n: g for g, names in GIVEN.items() for n in names}
_TITLE = {t: g for g, names in TITLES.items() for t in names}
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:[-'’][^\W\d_]+)*"

_SECRET = re.compile(r"""(?:[Pp]assw(?:or)?d|PASSW(?:OR)?D|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa][Pp][Ii][_-]?[Kk][Ee][Yy])["']?\s*[=:]\s*["']?([^\s"',;]{6,})""")
_PATTERNS = [
    ("secret", re.compile(r"AKIA[0-9A-Z]{16}")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z_-]{20,}|xox[abp]-[0-9A-Za-z-]{10,})")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("ip", re.compile(r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("card", re.compile(r"(?<![0-9])[3-6](?:[ -]?[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])")),
]
_DIGIT = re.compile(r"[0-9]")
_MAIL_RIGHT = re.compile(r"@((?:[\w-]+\.)+[^\W\d_]{2,})")
_MAIL_LEFT = re.compile(r"[\w.%+'-]+")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]*::)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![\w:])")
_FULL = "((?:" + _CAP + r"[ \t]+){0,2}" + _CAP + ")"
_TITLED = re.compile(r"(?<!\w)(" + "|".join(sorted(_TITLE, key=len, reverse=True)) + r")\.?[ \t]+" + _FULL)
# Words that introduce a name, by the gender they tell; words of saying; capitalised words that are no names.
_CUES = {
    "n": ("[Mm]y name is", "[Nn]ame:", "[Ii]ch heiße", "[Mm]ein Name ist", "[Jj]e m['’]appelle", "[Mm]on nom est", "[Mm]e llamo", "[Mm]i nombre es", "[Мм]еня зовут", "Dear", "[Rr]egards,", "[Ss]incerely,"),
    "f": ("Liebe", "Chère", "Estimada"),
    "m": ("Lieber", "Cher", "Estimado"),
}
_SAYING = "called wrote said asked told replied dijo escribió".split()
_NO_NAMES = frozenset("The A An My His Her Our Their This That It He She We They You I In On At And But Or If When El La Los Las Un Una Le Les Der Die Das Sir Madam All Friend Friends Team Customer".split())
_NO_NAMES |= frozenset("Later Then Now Today Yesterday Tomorrow Soon Finally Meanwhile However Once After Before While Here There What Who Why How Where Since Because Although Perhaps Maybe Yes No Not New San Santa Saint Los Las North South East West Central Great Mount Lake Fort Port United Dann Heute Gestern Später Alors Puis Hier Demain Luego Ayer Hoy Nuevo Nueva Sankt Bad".split())
_OFFICES = frozenset("President Minister Chancellor Senator Governor Mayor Chairman Director Captain General Professor Doctor Judge King Queen Prince Princess Pope Präsident Präsidentin Kanzler Kanzlerin Bürgermeister Président Présidente Ministre Presidente Presidenta Ministro Ministra".split())
_NOT_SAID = _NO_NAMES | _OFFICES | frozenset(_TITLE)
_CUED = [(g, re.compile(r"(?<!\w)(?:" + "|".join(cues) + r")\s+" + _FULL)) for g, cues in _CUES.items()]
_SAID = re.compile(r"(?<!\w)(" + _CAP + r"[ \t]+" + _CAP + r")(?=[ \t]+(?:" + "|".join(_SAYING) + r")(?!\w))")
_SAID_AT = re.compile(r"[ \t](?:" + "|".join(_SAYING) + r")(?!\w)")
_CAPS = re.compile(r"(?<!\w)" + _CAP + r"(?!\w)")
_AFTER = re.compile(r"[ \t]+(" + _CAP + ")")


def _parts(at: int, full: str, gender: str) -> Iterator[tuple[int, int, str]]:
    """The parts of a full name; the last of several is the surname, a single one a given name if it is listed."""
    parts = list(re.finditer(_CAP, full))
    for i, p in enumerate(parts):
        given = i < len(parts) - 1 or (len(parts) == 1 and p[0] in _GENDER)
        yield at + p.start(), at + p.end(), f"given_{_GENDER.get(p[0], gender)}" if given else "surname"


def _names(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _TITLED.finditer(text):
        yield from _parts(m.start(2), m[2], _TITLE[m[1]])
    for gender, pattern in _CUED:
        for m in pattern.finditer(text):
            if m[1].split()[0] not in _NO_NAMES:
                yield from _parts(m.start(1), m[1], gender)
    if _SAID_AT.search(text):
        for m in _SAID.finditer(text):
            office, _, rest = m[1].partition(" ")
            if office in _OFFICES:
                if rest.strip() not in _NO_NAMES | _OFFICES:
                    yield m.end(1) - len(rest.strip()), m.end(1), "surname"
            elif _NOT_SAID.isdisjoint(m[1].split()):
                yield from _parts(m.start(1), m[1], "n")
    for m in _CAPS.finditer(text):
        first = re.split("[-'’]", m[0])[0]
        if first in _GENDER:
            yield m.start(), m.end(), f"given_{_GENDER[first]}"
            if (after := _AFTER.match(text, m.end())) and after[1] not in _GENDER:
                yield after.start(1), after.end(1), "surname"


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps; of overlapping ones the first found stays."""
    found: list[tuple[int, int, str]] = []
    found += [(m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text)]
    at, last = text.find("@"), 0
    while at >= 0:
        right, left = _MAIL_RIGHT.match(text, at), _MAIL_LEFT.match(text[last:at][::-1])  # read backwards, each character once
        if right and left:
            found.append((at - len(left[0]), right.end(), "email"))
        at, last = text.find("@", at + 1), at + 1
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), kind) for kind, p in _PATTERNS for m in p.finditer(text)]
    if "::" in text or text.count(":") >= 7:
        found += [(m.start(), m.end(), "ip6") for m in _IP6.finditer(text) if _is_ip6(m[0])]
    named = list(_names(text))
    found += named
    values: dict[str, str] = {}
    for a, b, k in named:
        values.setdefault(text[a:b], k)
    if values:  # later mentions of any part alone
        found += [(m.start(), m.end(), values[m[0]]) for m in _CAPS.finditer(text) if m[0] in values]
    out: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    for a, b, k in found:
        if taken.find(1, a, b) < 0:
            taken[a:b] = b"\x01" * (b - a)
            out.append((a, b, k))
    return sorted(out)


def _is_ip6(value: str) -> bool:
    try:
        return sum(map(bool, ipaddress.IPv6Address(value).exploded.replace("0", "").split(":"))) > 1
    except ValueError:
        return False


# ---------------------------------------------------------------- surrogates
class _Stream:
    """Numbers drawn from HMAC-SHA256 of what is replaced."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.turn, self.bytes = key, "\x00".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 8:
            self.bytes += hmac.new(self.key, self.turn.to_bytes(4, "big") + self.what, hashlib.sha256).digest()
            self.turn += 1
        x, self.bytes = int.from_bytes(self.bytes[:8], "big"), self.bytes[8:]
        return x % n


# Letters in use of Cyrillic, Greek, accented Latin, Hebrew and Arabic.
_LETTERS = [range(0x430, 0x450), range(0x410, 0x430), range(0x3B1, 0x3CA), range(0x391, 0x3AA), range(0xDF, 0x100), range(0xC0, 0xDF), range(0x5D0, 0x5EB), range(0x627, 0x64B)]


@lru_cache(4096)
def _alphabet(c: str) -> str:
    """Letters of the script and case of c."""
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if "A" <= c <= "Z":
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    here = next((r for r in _LETTERS if ord(c) in r), range(max(0, ord(c) - 31), ord(c) + 32))
    script, kind = unicodedata.name(c, "?").split(" ")[0], unicodedata.category(c)
    near = [chr(x) for x in here if unicodedata.category(chr(x)) == kind and unicodedata.name(chr(x), "").startswith(script)]
    return "".join(near) or c


def family(kind: str) -> str:
    """What values are told apart within: all kinds of names are one family."""
    return "name" if kind == "surname" or kind.startswith("given_") else kind


def folded(kinds: set[str]) -> str:
    """The kind of a value that was found as several."""
    given = sorted(k for k in kinds if k.startswith("given_"))
    sure = [k for k in given if k != "given_n"]
    return sure[0] if len(sure) == 1 else "given_n" if given else min(kinds)


#: Attempt from which values are drawn longer: by then those of their own length are scarce.
GROWS = 12


def _grown(value: str, attempt: int, draw: _Stream) -> str:
    """value with a character more, like its last, for every fourth attempt from GROWS on."""
    more = ""
    for _ in range((attempt - GROWS) // 4 + 1 if attempt >= GROWS else 0):
        c = value[-1:]
        letters = _alphabet(c.lower() if len(value) > 1 and not value.isupper() else c) if c.isalpha() else "0123456789"
        more += letters[draw.below(len(letters))]
    return value + more


def shaped(value: str, draw: _Stream, hexadecimal: bool = False) -> str:
    """Each digit by a digit, each letter by one of its script and case; everything else stays."""
    out = []
    for i, c in enumerate(value):
        if "0" <= c <= "9":
            lead = i == 0 or not value[i - 1].isdigit()
            out.append("123456789"[draw.below(9)] if lead and c != "0" else "0123456789"[draw.below(10)])
        elif hexadecimal and c in "abcdef":
            out.append("abcdef"[draw.below(6)])
        elif c.isalpha():
            letters = _alphabet(c)
            out.append(letters[draw.below(len(letters))])
        else:
            out.append(c)
    return "".join(out)


# Syllables (onsets, vowels) of made-up given names by script, and endings by gender; no ending of one gender
# ends in the last letter of one of the other.
SYLLABLES = {
    "LATIN": ("b br c d dr f g gr k l m n p r s st t tr v z".split(), "a e i o u".split()),
    "CYRILLIC": ("б бр в г д др з к л м н п р с ст т тр ф".split(), "а е и о у".split()),
    "GREEK": ("β γ δ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο".split()),
    "HEBREW": ("ב ג ד ז ח ט ל מ נ ס ק ר ש".split(), ["", "ו", "י"]),
    "ARABIC": ("ب ت ج ح د ر ز س ش ف ق ك ل م ن".split(), ["", "ا", "و", "ي"]),
}
ENDINGS = {
    "LATIN": {"f": "lina mina rella nora lia nette vina sa".split(), "m": "bert lon mir ndro rik tus nald vor".split()},
    "CYRILLIC": {"f": "лина мила нора рия сена вета".split(), "m": "слав мир тон рик дор лан".split()},
    "GREEK": {"f": "λια νη ρινα τια".split(), "m": "νος ρης λας τιος".split()},
    "HEBREW": {"f": "לית נה רית".split(), "m": "אל רון דב".split()},
    "ARABIC": {"f": "لية مة نة".split(), "m": "دين مان رير".split()},
}
_JOINS = re.compile("([-'’])")


def made_name(gender: str, like: str, attempt: int, draw: _Stream) -> str | None:
    """A given name that is not listed, in the script, case and joints of another; None in a script without syllables."""
    script = next((unicodedata.name(c, "?").split(" ")[0] for c in like if c.isalpha()), "?")
    if script not in SYLLABLES:
        return None
    onsets, vowels = SYLLABLES[script]
    endings = ENDINGS[script].get(gender) or sum(ENDINGS[script].values(), [])
    out = []
    for part in _JOINS.split(like):
        if _JOINS.fullmatch(part):
            out.append(part)
            continue
        name = ""
        while not name or name.capitalize() in _GENDER:
            stem = "".join(onsets[draw.below(len(onsets))] + vowels[draw.below(len(vowels))] for _ in range(2 + attempt // 4))
            name = stem + endings[draw.below(len(endings))]
        out.append(name.upper() if len(part) > 1 and part.isupper() else name.capitalize() if part[:1].isupper() else name)
    return "".join(out)


def luhn(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _with_digits(value: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in value)


def _octet(o: str, attempt: int, draw: _Stream) -> str:
    low, high = {1: (1, 9), 2: (10, 99)}.get(len(o), (100, 254)) if attempt < GROWS else (1, 254)
    return str(low + draw.below(high - low + 1))


def _group(g: str, attempt: int, draw: _Stream) -> str:
    """Hexadecimal digits for others, of one case; a short group grows once its own digits are used up."""
    letters = "ABCDEF" if g.isupper() else "abcdef"
    digits = "".join(letters[draw.below(6)] if c.isalpha() else "123456789"[draw.below(9)] for c in g)
    return digits if attempt < 4 else digits + "".join("0123456789"[draw.below(10)] for _ in range(4 - len(g)))


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    draw = _Stream(key, kind, value, str(attempt))
    if kind == "domain":
        *labels, top = value.split(".")
        host = [shaped(x, _Stream(key, kind, x, f"{attempt}" if attempt else "")) for x in labels]
        return ".".join([*host[:-1], _grown(host[-1], attempt, draw), top])
    if kind == "email":  # its domain is drawn again on its own where that meets another
        local, _, domain = value.rpartition("@")
        return f"{_grown(shaped(local, draw), attempt, draw)}@{surrogate(key, 'domain', domain, 0)}"
    if kind == "ip":
        return ".".join(_octet(o, attempt, draw) for o in value.split("."))
    if kind == "ip6":
        return ":".join(_group(g, attempt, draw) if g else "" for g in value.split(":"))
    if kind == "card":
        digits = "".join(c for c in value if c.isdigit())
        new = digits[0] + shaped("0" * (len(digits) - 1), draw)
        if luhn(digits) == 0:
            new = next(new[:-1] + str(d) for d in range(10) if luhn(new[:-1] + str(d)) == 0)
        return _with_digits(value, new)
    if kind == "iban":
        plain = value.replace(" ", "")
        body = shaped(plain[4:], draw)
        number = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00"))
        out, it = [], iter(plain[:2] + f"{98 - number % 97:02d}" + body)
        return "".join(out + [" " if c == " " else next(it) for c in value])
    if kind == "phone":
        lead = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
        cut = lead.end() if lead else 0
        return value[:cut] + shaped(value[cut:], draw)
    if kind == "secret":
        if value.startswith("AKIA"):
            return "AKIA" + shaped(value[4:], draw)
        plain = re.fullmatch(r"[0-9a-f]+", value) is not None
        return shaped(value, draw, hexadecimal=plain) if plain else _grown(shaped(value, draw), attempt, draw)
    if kind.startswith("given_"):
        if value.isascii() and attempt < 2 and not _JOINS.search(value):
            pool = GIVEN.get(kind[6:]) or GIVEN["f"] + GIVEN["m"]
            name = pool[draw.below(len(pool))]
            return name.upper() if value.isupper() else name
        if name := made_name(kind[6:], value, attempt, draw):
            return name
    if family(kind) == "name":
        return _grown(shaped(value, draw), attempt, draw)
    return shaped(value, draw)


# ---------------------------------------------------------------- Spark
def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, kinds, values = [], [], []
        for r, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py()
            if t:
                found = dict.fromkeys((k, t[a:b]) for a, b, k in spans(t))
                found |= dict.fromkeys(("domain", v.rpartition("@")[2]) for k, v in found if k == "email")
                for kind, value in found:
                    rid.append(r)
                    kinds.append(kind)
                    values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["rid", "kind", "value"])


def _draw(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [surrogate(key, k, v, attempt) for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.string())], ["kind", "value", "surrogate"])

    return run


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts, kinds = [], [], []
        for t, pairs in zip(batch.column(1), batch.column(2), strict=True):
            t, pairs = t.as_py(), pairs.as_py()
            n, found = 0, set()
            if t and pairs:
                new = {(p["family"], p["value"]): p["surrogate"] for p in pairs}
                out, at = [], 0
                for a, b, k in spans(t):
                    other = new[family(k), t[a:b]]
                    if k == "email":
                        other = other.rpartition("@")[0] + "@" + new["domain", t[a:b].rpartition("@")[2]]
                    out += [t[at:a], other]
                    at, n = b, n + 1
                    found.add(k)
                t = "".join([*out, t[at:]])
            texts.append(t)
            counts.append(n)
            kinds.append(",".join(sorted(found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], ["id", "text", "n_entities", "kinds"])


def _family() -> Column:
    return F.when(F.col("kind").startswith("given_") | (F.col("kind") == "surname"), "name").otherwise(F.col("kind"))


def _one_kind(entities: DataFrame) -> DataFrame:
    """(family, kind, value): the kinds that a value of a family was found as, folded into one (see `folded`)."""
    has = lambda k: F.bool_or(F.col("kind") == k)
    sums = entities.groupBy(_family().alias("family"), "value").agg(has("given_f").alias("f"), has("given_m").alias("m"), has("given_n").alias("n"), F.min("kind").alias("least"))
    kind = F.when(F.col("f") & ~F.col("m"), "given_f").when(F.col("m") & ~F.col("f"), "given_m").when(F.col("f") | F.col("m") | F.col("n"), "given_n").otherwise(F.col("least"))
    return sums.select("family", kind.alias("kind"), "value")


def surrogates(entities: DataFrame, key: bytes, attempts: int = 1000) -> DataFrame:
    """(family, kind, value, surrogate) of distinct entities (kind, value): one for each value of a family, one-to-one, and no
    surrogate is a value of the corpus. Values that are left after an attempt are drawn again; what cannot grow (numbers of a
    fixed form) has billions of draws."""
    entities = C.written(_one_kind(entities.select("kind", "value")), "entities")
    originals = entities.select(F.col("value").alias("surrogate")).distinct()
    done: DataFrame | None = None
    todo = entities
    for attempt in range(attempts):
        drawn = C.written(todo.select("kind", "value").mapInArrow(_draw(key, attempt), "kind string, value string, surrogate string"), "draws")
        free = drawn.join(originals, "surrogate", "left_anti")
        if done is not None:
            free = free.join(done.select("surrogate"), "surrogate", "left_anti")
        won = free.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("w")).select("w.kind", "w.value", "surrogate").select(_family().alias("family"), "kind", "value", "surrogate")
        won = C.written(won, "surrogates")
        done = won if done is None else done.unionByName(won)
        todo = C.written(todo.join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "again")
        if not todo.limit(1).count():
            return done
    raise RuntimeError("the surrogates of a kind of fixed form are exhausted")


def pseudonymised(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text with surrogates, n_entities, kinds (comma-joined)."""
    keyed = C.with_row_key(docs, id_col, text_col).select("rid", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = C.written(keyed.select("rid", "text").mapInArrow(_detect, "rid long, kind string, value string"), "found")
    named = surrogates(found, key).select("family", "value", "surrogate")
    once = found.select("rid", _family().alias("family"), "value").distinct()
    per = once.join(named, ["family", "value"]).groupBy("rid").agg(F.collect_list(F.struct("family", "value", "surrogate")).alias("pairs"))
    out = keyed.join(per, "rid", "left").select("id", "text", "pairs").mapInArrow(_replace, "id long, text string, n_entities long, kinds string")
    return out.withColumnsRenamed({"id": id_col, "text": text_col})
