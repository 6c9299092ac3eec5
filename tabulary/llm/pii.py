"""Personal information in free text: anchors by Aho-Corasick, expanded and validated by deterministic local parsers."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.session import table

# What shows where to look. Titles and phrases stand before a name, unless said otherwise.
TITLES = ("dr", "mr", "mrs", "ms", "miss", "sir", "prof.", "professor", "herr", "fru", "fröken", "frau", "dominus", "domina")
BEFORE_NAMES = (
    "i spoke with", "talked to", "met with", "transcribed by", "written by", "signed by", "drawn by", "copied by", "edited by", "ask for", "write to", "contact", "issued to", "sheets to", "send to", "on behalf of",
    "regards,", "sincerely,", "yours,", "from:", "to:", "cc:", "note:", "by:", "name:", "namn:", "nomen:", "från:", "till:", "anm:", "not:", "hälsningar", "hälsningar,", "skriv till", "skickas till", "talade med", "fråga efter", "ring", "kontakta",
    "utfärdat till", "avskrift av", "avskrivet av", "läst av", "ritad av", "descripsit", "scripsit", "transcripsit", "vale,", "valete,",
)
AFTER_NAMES = (" can be reached", " may be reached", " nås på", " har läst ", " checked the ", " lent us ")
#: What people do: stands after a name of any shape.
SPEAKING = (" wrote ", " writes ", " said ", " says ", " told ", " replied ", " skrev ", " säger ", " sade ", " berättade ")
AT_SIGNS = ("@", "＠", "(at)", "[at]", "{at}", "<at>", "%40")
SPELLED_AT = (" at ", " snabel-a ")
SCHEMES = {"mailto:": "mail", "xmpp:": "mail", "sip:": "mail", "tel:": "call", "sms:": "call", "callto:": "call", "fax:": "call"}
PHONE_CUES = ("phone number", "phone:", "telephone:", "tel.", "tel ", "telefon ", "telefon:", "mobile:", "mobile ", "mobil:", "mobil ", "fax ", "call me on ", "call me at ", "call ", "ring me on ", "ring ", "dial ", "nås på ")
NO_PHONE = ("folio", "fol", "f", "ff", "ms", "shelfmark", "ref", "refs", "page", "p", "pp", "inv", "line", "build", "version", "sheet", "plan", "item", "order", "catalogue", "nummer", "no", "nr", "num")
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SD SE SI SK SM ST SV TL TN TR UA VA VG XK".split()
ID_CUES = ("card", "identity", "personnummer", "personnr", "samordningsnummer", "lånekort", "passport", "ssn", "social security", "insurance n", "licence n", "license n", "id-nummer", "id number", "an id", "id no", "id:", "id (", "tessera", "account n", "kontonummer")
STREET_ENDS = ("gatan", "gata", "vägen", "väg", "torget", "torg", "gränden", "gränd", "stigen", "backen", "allén", "straße", "strasse", "str.", "platz", "weg", "allee", "gasse", "ufer")
STREET_WORDS = ("Street", "St.", "St", "Road", "Rd.", "Rd", "Avenue", "Ave.", "Ave", "Lane", "Ln", "Court", "Ct", "Close", "Terrace", "Hill", "Drive", "Dr.", "Way", "Square", "Sq.", "Place", "Crescent", "Gardens", "Row", "Boulevard", "Blvd")
STREET_STARTS = ("Via", "Viale", "Piazza", "Calle", "Rua", "Avenida", "Vicolo", "Largo")
FRENCH = ("rue", "avenue", "av.", "place", "bd.", "bd", "boulevard", "chemin", "quai", "allée", "impasse")
FLATS = ("Flat", "Apt", "Apt.", "Apartment", "Unit", "Suite", "Lgh")
PARTICLES = ("van der", "van den", "van de", "van", "von der", "von", "af", "de la", "de", "den", "der", "del", "du", "di", "da", "dos", "le", "la", "zu", "zur", "ter", "ten", "av")
FAMILY_ENDS = ("berger", "berg", "strand", "holt", "hurst", "lund", "vik", "wick", "by", "ley", "ton", "sen", "son", "der", "mar", "ow", "beck", "feldt", "feld", "gaard", "mann", "ström", "stad", "qvist", "kvist", "gren", "dal", "ham", "ford", "field", "wood", "well", "stein", "bach", "ski", "sky", "ov", "ova", "ez", "ini", "elli")

S = r"(?:[  ]\n?|\n)"
GAP = r"[     ]"
WORD = r"\p{Lu}[\p{L}'’]+"
FAMILY = rf"{WORD}(?:-{WORD})*"
INITIALS = rf"(?:\p{{Lu}}\.(?:{GAP}?-?))*\p{{Lu}}\."
PARTICLE = rf"(?:(?i:{'|'.join(PARTICLES)}){S})*"
FIRST = rf"(?:{WORD}(?:-{WORD})?|{INITIALS})"
FULL = rf"(?P<first>{FIRST}){S}?(?:(?<=[  \n.])(?:{INITIALS}{S}?|{WORD}{S}(?={PARTICLE}{WORD})){{0,2}})(?<=[  \n.]){PARTICLE}(?P<family>{FAMILY})"
TURNED = rf"{PARTICLE}(?P<family>{FAMILY}),{S}(?P<first>{FIRST})(?:{S}{INITIALS})*(?:{S}(?i:{'|'.join(PARTICLES)})(?![\p{{L}}]))?"
TURNED_BEFORE = regex.compile(rf"(?<![\p{{L}}\p{{N}}-]){PARTICLE}(?P<family>{FAMILY}),{S}$")
# Capitalised words that begin sentences and are no names.
STARTERS = {"The", "A", "An", "This", "That", "These", "Those", "In", "On", "At", "As", "When", "Then", "Here", "There", "My", "Our", "Their", "His", "Her", "Den", "Det", "De", "En", "Ett", "När", "Här", "Saint", "St", "Pope", "King", "Emperor", "Bishop"}
SPEAKER = regex.compile(rf"(?<![\p{{L}}\p{{N}}.@-])(?<!\p{{Lu}}[\p{{L}}'’-]*{S})(?P<name>(?P<first>{FIRST}){S}{PARTICLE}(?P<family>{FAMILY}))$")
NAME_BEFORE = regex.compile(rf"(?<![\p{{L}}\p{{N}}.@-])(?P<name>{TURNED}|{FULL})$")

LOCAL = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+-]*[\p{L}\p{N}_+-])?$")
DOT = rf"(?:\.|{GAP}?[(\[{{<](?:dot|punkt|punctum)[)\]}}>]{GAP}?|{GAP}(?:dot|punkt){GAP})"
DOMAIN = regex.compile(rf"{GAP}?(?P<domain>[\p{{L}}\p{{N}}-]+(?:{DOT}[\p{{L}}\p{{N}}-]+)*{DOT}\p{{L}}{{2,}})(?![\p{{L}}\p{{N}}])", regex.I)

PHONE = regex.compile(
    rf"(?:(?:\+{GAP}?|00)[1-9]\d{{0,2}}(?:{GAP}?\(0\))?(?:{GAP}?[./-]?{GAP}?(?:\(\d{{2,5}}\)|\d{{2,5}})){{2,6}}|\+?[1-9]?{GAP}?\(0?\d{{1,4}}\)(?:{GAP}?[/.-]?{GAP}?\d{{2,4}}){{1,5}}|0\d{{1,4}}{GAP}?[/-]?{GAP}?\d{{2,3}}(?:[-.]?{GAP}?\d{{2,3}}){{0,4}}|0\d{{6,11}}|\d{{3}}-\d{{4}})(?![\d]|[-/.:]\d|\p{{L}})"
)
ID = regex.compile(r"(?<![\p{L}\p{N}])(?:[A-Z]{1,3}[ -]?|[a-z]{1,3}-)?\d(?:[ -]?\d){5,}+(?:[ -]?[A-Z](?![\p{L}\p{N}]))?(?![\p{L}\p{N}]|-\d)")
LONG = regex.compile(r"(?<![\p{L}\p{N}.,/+-])(?<![\p{N}][ ])\d(?:[ -]?\d){11,}+(?![\p{L}\p{N}]|[-./]\d)")
IBAN = regex.compile(r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?:[ ]?[A-Z\d]){11,30}(?![\p{L}\p{N}])")
LOOSE_PHONE = regex.compile(r"(?:\+|00)?\(?\d(?:[ ./-]?[()]?\d){5,}+(?![\p{L}\p{N}]|[-./]\d)")
NATIONAL_PHONE = regex.compile(r"(?:\(\d{3}\)[ ]?|\d{3}(?P<mark>[-. ]))\d{3}(?(mark)(?P=mark)|[-. ])\d{4}(?![\p{L}\p{N}]|[-./ ]\d)")
SPELLED_LOCAL = regex.compile(r"(?<![\p{L}\p{N}])[\p{L}\p{N}_-]+(?:[ ](?:dot|punkt|punctum)[ ][\p{L}\p{N}_-]+)*$", regex.I)
SPELLED_DOMAIN = regex.compile(r"(?P<domain>[\p{L}\p{N}-]+(?:[ ](?:dot|punkt|punctum)[ ][\p{L}\p{N}-]+)*[ ](?:dot|punkt|punctum)[ ]\p{L}{2,})(?![\p{L}\p{N}])", regex.I)
ID_SHAPES = regex.compile(r"(?<![\p{L}\p{N}./-])(?:(?:19|20)?\d{6}[-+]\d{4}|\d{3}-\d{2}-\d{4}|[A-Za-z]{2}[ -]\d{3}[ -]\d{3}[ -]\d|[A-Z]{2}\d{6}-?\d)(?![\p{L}\p{N}]|[-./]\d)")
TOWN = rf"\p{{Lu}}[\p{{L}}-]+(?:{GAP}\p{{Lu}}[\p{{L}}-]+)?"
CODE = rf"(?:\d{{3}}{GAP}\d{{2}}|\d{{4,5}}|[A-Z]{{1,2}}\d[A-Z\d]?{GAP}\d[A-Z]{{2}})"
TAIL = rf"(?:,{S}(?:{CODE}{S}{TOWN}|{TOWN}{S}{CODE}(?!\d)|{CODE}(?!\d)))?"
NUMBER = rf"\d{{1,4}}(?:{GAP}?[a-zA-Z](?![\p{{L}}\p{{N}}]))?"
STREET = (
    rf"(?:{NUMBER},?{S}\p{{Lu}}[\p{{L}}'’-]+(?:{S}\p{{Lu}}[\p{{L}}'’-]+)?{S}(?:{'|'.join(regex.escape(w) for w in sorted(STREET_WORDS, key=len, reverse=True))})(?![\p{{L}}])"
    rf"|{NUMBER},?{S}(?i:{'|'.join(FRENCH)}){S}(?:d(?:u|e|es)(?:{S}la)?{S}|de{S}l['’]|d['’])?\p{{Lu}}[\p{{L}}'’-]+"
    rf"|(?:{'|'.join(STREET_STARTS)}){S}(?:d[eiu](?:l|lla|i)?{S})?\p{{Lu}}[\p{{L}}'’-]+(?:{S}\p{{Lu}}[\p{{L}}'’-]+)?,?{S}{NUMBER}"
    rf"|\p{{Lu}}[\p{{L}}-]*?(?i:{'|'.join(map(regex.escape, STREET_ENDS))}){S}?{NUMBER})"
)
FLAT = rf"(?:(?:{'|'.join(map(regex.escape, FLATS))}){S}\d+[a-zA-Z]?,?{S})"
ADDRESS = regex.compile(rf"(?<![\p{{L}}\p{{N}}]){FLAT}?{STREET}{TAIL}")
STREET_END = regex.compile(rf"(?:{'|'.join(map(regex.escape, STREET_ENDS))})$", regex.I)

PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id": "[ID]", "addr": "[ADDRESS]"}
RANK = {"email": 0, "addr": 1, "id": 2, "phone": 3, "name": 4}
MAX_NAMES = 1_000_000


def lowered(text: str) -> str:
    """Lower case of the same length, so that places in it are places in the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others, as on cards and in Swedish personal numbers."""
    twice = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def iban_holds(text: str) -> bool:
    """Whether the check digits of an account number hold: 1 modulo 97 with the country and check digits last."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _back(text: str, at: int, words: int) -> int:
    """Where the last `words` words before `at` begin: the grammars hold so many at most, of any length."""
    for _ in range(words):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return at


def _forth(text: str, at: int, words: int) -> int:
    """Where the next `words` words after `at` end."""
    size = len(text)
    for _ in range(words):
        while at < size and text[at].isspace():
            at += 1
        while at < size and not text[at].isspace():
            at += 1
    return at


@dataclass(frozen=True)
class Cues:
    """The word lists a detector goes by, for texts of other kinds or languages."""

    titles: Sequence[str] = TITLES
    before_names: Sequence[str] = BEFORE_NAMES
    after_names: Sequence[str] = AFTER_NAMES
    speaking: Sequence[str] = SPEAKING
    family_ends: Sequence[str] = FAMILY_ENDS
    ids: Sequence[str] = ID_CUES
    phones: Sequence[str] = PHONE_CUES
    no_phones: Sequence[str] = NO_PHONE


class Detector:
    """Finds anchors of all types in one pass of an automaton and parses around each."""

    def __init__(self, given_names: Iterable[str] = (), cues: Cues | None = None):
        self.cues = cues or Cues()
        self.shape = regex.compile(rf"(?:{'|'.join(map(regex.escape, self.cues.family_ends))})$", regex.I)
        self.no_first = {*self.cues.titles, *(p.split()[-1] for p in self.cues.before_names), "med", "kind", "best", "vänliga"}
        title = "|".join(map(regex.escape, self.cues.titles))
        self.name_after = regex.compile(rf"{S}{{0,3}}(?:(?i:{title})\.?{S})*(?P<name>{TURNED}|{FULL})(?![\p{{L}}\p{{N}}])")
        anchors: dict[str, set[str]] = {}

        def add(kind: str, *texts: str) -> None:
            for text in texts:
                anchors.setdefault(text, set()).add(kind)

        add("at", *AT_SIGNS)
        self.given = {n.lower() for n in given_names if n and n.strip()}
        add("given", *self.given)
        add("before", *[t + s for t in (*self.cues.titles, *self.cues.before_names) for s in (" ", "\n")], *[t + ". " for t in self.cues.titles if t[-1] != "."])
        add("after", *self.cues.after_names)
        add("speaks", *self.cues.speaking)
        add("id", *self.cues.ids)
        add("street", *STREET_ENDS, *[" " + w.lower() for w in STREET_WORDS], *[w.lower() + " " for w in STREET_STARTS], *[" " + w + " " for w in FRENCH], *[w.lower() + " " for w in FLATS])
        add("phone", "+", *[c + "0" for c in " \n([: "], *[f"({d}" for d in range(1, 10)])
        add("spelled", *SPELLED_AT)
        add("call", *self.cues.phones, *[t for t, kind in SCHEMES.items() if kind == "call"])
        add("mail", *[t for t, kind in SCHEMES.items() if kind == "mail"])
        add("iban", *[c.lower() + str(d) for c in IBAN_COUNTRIES for d in range(10)])
        add("dash", *[f"{d}-" for d in range(10)])
        self.automaton = ahocorasick.Automaton()
        for text, kinds in anchors.items():
            self.automaton.add_word(text, (len(text), tuple(sorted(kinds))))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of what was found, in order and without overlaps."""
        low = lowered(text)
        found: set[tuple[int, int, str]] = set()
        for last, (size, kinds) in self.automaton.iter(low):
            start, end = last + 1 - size, last + 1
            for kind in kinds:
                getattr(self, f"_{kind}")(text, low, start, end, found)
        if text[:1] == "0":
            self._number(text, 0, found)
        self._long_numbers(text, found)
        self._beside_contacts(text, found)
        kept: list[tuple[int, int, str]] = []
        for span in sorted(found, key=lambda s: (RANK[s[2]], -(s[1] - s[0]), s[0])):
            at = bisect(kept, span)
            if (at == 0 or kept[at - 1][1] <= span[0]) and (at == len(kept) or kept[at][0] >= span[1]):
                kept.insert(at, span)
        return kept

    def _at(self, text: str, low: str, start: int, end: int, found: set) -> None:
        left = start - (start > 0 and text[start - 1] in "  ")
        base = left
        while base and (text[base - 1].isalnum() or text[base - 1] in "._%+-"):
            base -= 1
        local = LOCAL.search(text, base, left)
        domain = DOMAIN.match(text, end)
        if local and domain and local.end() == left:
            found.add((local.start(), domain.end(), "email"))

    def _spelled(self, text: str, low: str, start: int, end: int, found: set) -> None:
        """An address with every mark written as a word: only where the domain has a spelled dot."""
        domain = SPELLED_DOMAIN.match(text, end)
        local = domain and SPELLED_LOCAL.search(text, _back(text, start, 9), start)
        if local:
            found.add((local.start(), domain.end(), "email"))

    def _mail(self, text: str, low: str, start: int, end: int, found: set) -> None:
        at = text.find("@", end, _forth(text, end, 1))
        if at > 0:
            self._at(text, low, at, at + 1, found)

    def _call(self, text: str, low: str, start: int, end: int, found: set) -> None:
        """A number right after a scheme or a cue may have any layout."""
        if start and text[start - 1].isalnum():
            return
        at = end
        while at < len(text) and text[at] in " :":
            at += 1
        match = LOOSE_PHONE.match(text, at)
        if match and 7 <= sum(map(str.isdigit, match.group())) <= 15:
            found.add((match.start() + (match.group()[0] == "(" and ")" not in match.group()), match.end(), "phone"))

    def _iban(self, text: str, low: str, start: int, end: int, found: set) -> None:
        match = IBAN.match(text, start)
        while match and not iban_holds(match.group()):
            match = IBAN.fullmatch(text, start, start + match.group().rfind(" ")) if " " in match.group() else None
        if match:
            found.add((*match.span(), "id"))

    def _given(self, text: str, low: str, start: int, end: int, found: set) -> None:
        if (start and (text[start - 1].isalnum() or text[start - 1] in "-@._")) or (end < len(text) and (text[end].isalnum() or text[end] in "@_")) or not text[start].isupper():
            return
        match = self.name_after.match(text, start)
        if match and match.start("name") == start and match.group("first") and self._fits(match, text):
            found.add((*match.span("name"), "name"))
            return
        base = _back(text, start, 4)
        turned = TURNED_BEFORE.search(text, base, start)
        if turned and self.shape.search(turned["family"].split("-")[-1]):
            match = self.name_after.match(text, turned.start())
            if match and match.start("first") == start:
                found.add((*match.span("name"), "name"))

    def _fits(self, match: regex.Match, text: str, cued: bool = False) -> bool:
        first, family = match.group("first"), match.group("family")
        if first.lower() in self.no_first or first.lower() + "." in self.no_first:
            return False
        if match.group("name").find(",") >= 0 and not (cued or first.lower() in self.given):
            return False
        shaped = bool(self.shape.search(family.split("-")[-1]))
        if first.isupper() and len(first) > 2 and not first.endswith("."):
            return family.isupper() and shaped
        if family.isupper() or family.lower() in self.given:
            return False
        return shaped or cued or first.lower() in self.given

    def _before(self, text: str, low: str, start: int, end: int, found: set) -> None:
        if start and text[start - 1].isalnum():
            return
        match = self.name_after.match(text, end - 1)
        if match and self._fits(match, text, cued=True):
            found.add((*match.span("name"), "name"))

    def _after(self, text: str, low: str, start: int, end: int, found: set) -> None:
        self._name_ending(text, start, found)

    def _speaks(self, text: str, low: str, start: int, end: int, found: set) -> None:
        """Two names of any shape before a verb of speech, when no other name-like word goes before them."""
        match = SPEAKER.search(text, _back(text, start, 4), start)
        if match and match.group("first").lower() not in self.no_first and match.group("first") not in STARTERS and not match.group("family").isupper():
            found.add((*match.span("name"), "name"))

    def _name_ending(self, text: str, end: int, found: set) -> None:
        base = _back(text, end, 7)
        for match in NAME_BEFORE.finditer(text[base:end], overlapped=True):
            if self.shape.search(match.group("family").split("-")[-1]) and self._fits(match, text, cued=True):
                found.add((base + match.start("name"), base + match.end("name"), "name"))
                return

    def _beside_contacts(self, text: str, found: set) -> None:
        """Names right before an address or number, as in a signature or 'name <address>'."""
        for start, _, kind in [s for s in found if s[2] in ("email", "phone")]:
            lead = regex.search(r"(?:[  ]?[<(\[]|,[  \n]|\n|[  ](?:at|på|via)[  ])$", text[max(0, start - 6) : start])
            if lead:
                self._name_ending(text, start - len(lead.group()), found)

    def _id(self, text: str, low: str, start: int, end: int, found: set) -> None:
        if start and text[start - 1].isalnum():
            return
        stop = regex.compile(r"[.;\n](?!\S)|\n").search(text, end)
        match = ID.search(text, end, stop.start() if stop else len(text))
        if match and match.start() > _forth(text, end, 8):
            return
        if match and sum(c.isdigit() for c in match.group()) >= 6 and not regex.search(r"[@+(]", text[end : match.start()].replace("(", "", 1)):
            found.add((*match.span(), "id"))

    def _long_numbers(self, text: str, found: set) -> None:
        """Numbers whose check digit shows what they are: cards of 13 to 19 digits, personal numbers of 12; and 3-3-4 phone numbers."""
        for match in LONG.finditer(text):
            digits = "".join(filter(str.isdigit, match.group()))
            if len(digits) <= 19 and (len(digits) > 12 or digits[:2] in ("19", "20")) and luhn(digits[-10:] if len(digits) == 12 else digits):
                found.add((*match.span(), "id"))
        for match in NATIONAL_PHONE.finditer(text):
            if not match.start() or text[match.start() - 1] not in ".,/+-" and not text[match.start() - 1].isalnum() and text[_back(text, match.start(), 1) : match.start()].strip(" .:;,(").lower() not in self.cues.no_phones:
                found.add((*match.span(), "phone"))

    def _dash(self, text: str, low: str, start: int, end: int, found: set) -> None:
        base = max(0, start - 9)
        for pattern, kind in ((ID_SHAPES, "id"), (PHONE, "phone")):
            match = pattern.search(text, base, min(len(text), end + 12))
            while match and match.end() <= start:
                match = pattern.search(text, match.end(), min(len(text), end + 12))
            if match and match.start() <= start and kind == "id":
                found.add((*match.span(), "id"))
                return
        first = start
        while first and text[first - 1].isdigit():
            first -= 1
        self._number(text, first, found)

    def _phone(self, text: str, low: str, start: int, end: int, found: set) -> None:
        self._number(text, start if text[start] in "+(" else start + 1, found)
        if text[start] == "(" and text[start + 1 : start + 2].isdigit():
            self._number(text, start + 1, found)

    def _number(self, text: str, at: int, found: set) -> None:
        if at and (text[at - 1].isalnum() or text[at - 1] in "+./,:-"):
            return
        if at > 1 and text[at - 1] in "  -" and regex.search(r"(?:[A-Za-z]{2}|[\d/])[  -]$", text[max(0, at - 3) : at]) and not regex.search(r"\p{Ll}[  ]$", text[max(0, at - 3) : at]):
            return
        shape = ID_SHAPES.match(text, at)
        if shape:
            found.add((*shape.span(), "id"))
            return
        match = PHONE.match(text, at)
        if match and match.group().isdigit() and match.group().startswith("0") and text[_back(text, at, 1) : at].strip(" .:;,(").lower() in self.cues.no_phones:
            return
        if match and 7 <= sum(c.isdigit() for c in match.group()) <= 16:
            found.add((*match.span(), "phone"))

    def _street(self, text: str, low: str, start: int, end: int, found: set) -> None:
        base = _back(text, start, 8)
        for match in ADDRESS.finditer(text, base, _forth(text, end, 10)):
            if match.start() <= start and match.end() >= end - 1:
                found.add((*match.span(), "addr"))

    def redact(self, text: str) -> str:
        """The text with a placeholder for each span; the rest stays as it is."""
        parts, at = [], 0
        for start, end, kind in self.spans(text):
            parts += [text[at:start], PLACEHOLDER[kind]]
            at = end
        return "".join([*parts, text[at:]])


def _detector(given_names: DataFrame) -> list[str]:
    names = [r[0] for r in given_names.select(given_names.columns[0]).where(F.col(given_names.columns[0]).isNotNull()).distinct().limit(MAX_NAMES + 1).collect()]
    if len(names) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} given names; the automaton would not fit the tasks")
    return sorted(names)


def find(documents: DataFrame, given_names: DataFrame, cues: Cues | None = None) -> DataFrame:
    """(doc_id, pii_type, pii_text), one row per document and distinct string, for documents (doc_id, text).

    given_names: one column, at most MAX_NAMES values (checked), which only adds anchors. cues: other word lists. Whole texts are scanned in
    one pass each; only rows with text reach Python. Null and empty texts hold nothing.
    """
    names = _detector(given_names)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(names, cues)
        for batch in batches:
            rows = dict.fromkeys((doc, kind, text[a:b]) for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True) for a, b, kind in detector.spans(text))
            if rows:
                yield pd.DataFrame(list(rows), columns=["doc_id", "pii_type", "pii_text"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and text <> ''").mapInPandas(scan, "doc_id bigint, pii_type string, pii_text string")


def redact(documents: DataFrame, given_names: DataFrame, cues: Cues | None = None) -> DataFrame:
    """(doc_id, text) with typed placeholders in the place of personal information; null stays null, empty stays empty."""
    names = _detector(given_names)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(names, cues)
        for batch in batches:
            yield batch.assign(text=[t and detector.redact(t) for t in batch["text"]])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(scan, "doc_id bigint, text string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "given_name").select("given_name"))


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "documents"), table(spark, sf_dir, "given_name").select("given_name"))
