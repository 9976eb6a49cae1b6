"""Problem 5: personal information in free text.

Method: candidate gradient boosting. For each kind a generator of high recall proposes spans, which may overlap; features of
a span's format and of its context are scored by boosted trees; a threshold calibrated on held-out examples selects what is
redacted, and of overlapping selections the likeliest stays. The trees are trained on the driver from the labelled sentences
of ``pii_corpus`` (``TRAINING_SENTENCES`` of them, the same at every input size). Those were written for that file, about other
subjects than the pages; half of their names are on no list. ``tests/llm`` measures the trees on frames they were not trained on.

Cost: one pass over the texts in Arrow batches, no shuffle; candidates of a whole batch are scored at once. What the tasks
carry is the trained trees, a few hundred kilobytes whatever the corpus.

Defined results: null texts have no findings and stay null; a text of any length is read whole, line by line; a kind found
several times in a line gives one row in ``find_personal``; repeated rows give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.boosting import BoostedTrees

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[NAME]"}
TRAINING_SENTENCES = 9000
PRECISION = 0.985
#: Names are harder in training than in print, as half of them are made up there; their threshold asks for less.
NAME_PRECISION = 0.95
#: Texts whose candidates are scored together.
BATCH_TEXTS = 200

# Frequent given names of public statistics in English, Spanish and German speaking countries.
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark steven paul andrew joshua kevin brian george edward timothy jason jeffrey ryan jacob eric jonathan stephen benjamin samuel frank alexander patrick jack henry peter simon mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy margaret sandra ashley emily michelle amanda dorothy melissa deborah stephanie rebecca sharon laura cynthia amy angela anna emma nicole helen samantha katherine christine rachel catherine maria heather alice olivia grace "
    "antonio manuel jose francisco juan javier carlos jesus alejandro miguel rafael pedro pablo angel sergio fernando jorge luis alberto alvaro diego adrian raul ivan enrique ramon vicente andres carmen ana isabel cristina marta dolores lucia pilar elena sara paula raquel beatriz rosa silvia teresa julia irene alba andrea rocio monica mercedes sofia "
    "andreas wolfgang klaus stefan christian uwe bernd martin matthias jan tobias sebastian florian lukas felix jonas hans heinz karl max sabine petra monika susanne claudia birgit martina lena katharina ursula renate helga karin ingrid gisela hannah".split()
)
# Frequent surnames of the same statistics.
SURNAMES = frozenset(
    "smith johnson williams brown jones miller davis wilson anderson taylor moore jackson thompson white harris clark lewis robinson walker young allen king wright scott hill green adams baker nelson mitchell roberts carter phillips evans turner parker collins edwards stewart morris murphy cook rogers morgan cooper peterson reed bailey kelly howard ward watson brooks bennett gray hughes price myers "
    "garcia rodriguez gonzalez fernandez lopez martinez sanchez perez gomez martin jimenez ruiz hernandez diaz moreno alvarez romero alonso gutierrez navarro torres dominguez vazquez ramos gil ramirez serrano blanco suarez molina castro ortega delgado ortiz marin rubio "
    "müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann schäfer koch bauer richter klein wolf schröder neumann schwarz zimmermann braun krüger hofmann hartmann lange krause lehmann werner meier vogel keller".split()
)
# Words of the three languages that open sentences and menus, and so stand beside names.
_COMMON = frozenset(
    "the a an our this that these those in on at by for from with of and or if as but not no to all about after before between during since until while when where who whose what why how it its their his her your my we you they i he she us both each every some any more most last next first new old here there then thus also only please thank thanks dear welcome "
    "home contact news events jobs careers search menu login register account share print follow subscribe newsletter cookies privacy terms conditions copyright accept close open read back top page pages site map help support download video photos pictures gallery archive call write ask visit send email e-mail phone tel fax mobile mail address apply meet see join ring dial text office hours "
    "admissions research academics student students faculty staff alumni athletics campus library course courses room rooms department departments school award awards study studies work life guide rules notes directions overview "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "el la los las un una unos unas en de del al con sin por para según sobre tras desde hasta entre y o que se su sus es son este esta estos estas nuestro nuestra como más menos muy ya si qué cuando donde quien inicio contacto noticias agenda mapa ayuda buscar todo todos toda todas gracias correo teléfono dirección llame escriba premio lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "der die das den dem des ein eine einen einem einer im am an auf aus bei durch für mit nach über um unter vom von vor zum zur und oder aber wenn als wie wer was wo unser unsere ihr ihre sein seine kein keine alle mehr bitte danke hier dort laut startseite kontakt aktuelles suche hilfe anfahrt telefon anschrift thema teil zeit tag tage tagen woche wochen monat monate jahr jahre jahren jahres schritt sommer winter herbst frühling montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz juni juli oktober dezember".split()
)
_TITLES = frozenset(
    "dr dra prof professor profesor profesora mr mrs ms miss sr sra srta don doña dean frau herr herrn sir dame rector provost dekan dekanin decano decana".split()
)
_INSTITUTION = frozenset(
    "prize premio preis award hall halle wing annex library biblioteca bibliothek auditorium aula building edificio gebäude lodge house haus college university universidad universität hochschule institute instituto institut school escuela schule faculty facultad fakultät department departamento center centre centro zentrum campus museum museo foundation fundación stiftung lecture theatre theater teatro laboratory laboratorio office society club team union park garden tower gate bridge puente brücke chapel church stadium pavilion gallery court medal trophy trofeo cup pokal fellowship scholarship trust fund collection room chair saint san santa sons ltd inc saal".split()
)
_STREET = frozenset(
    "street st road rd avenue ave lane ln drive court ct way boulevard blvd place square terrace row close crescent hill calle avenida avda paseo plaza camino ronda straße strasse platz allee weg gasse".split()
)
_PHONE_CUES = frozenset(
    "phone tel telephone call calls calling fax mobile cell ring dial reach hotline whatsapp teléfono telefono tlf móvil llame llamar llamadas marque telefon tel.-nr anruf rufen wählen durchwahl mobil handy".split()
)
# Names of numbers and documents issued to a person, in the three languages.
_ID_PHRASE = re.compile(
    r"\b(?:ssn|social security|national insurance|identity|identification|national id|id card|(?:student|tax|taxpayer|personal|matriculation|passport|licen[cs]e) (?:id|no|nr|num|number|card|file)|passport|driving licen[cs]e|driver'?s licen[cs]e|id(?: no| number)?|dni|nie|nif|pasaporte|documento|seguridad social|carn[ée]|identidad|expediente (?:personal|acad[ée]mico)|matr[íi]cula|reisepass|(?:personal)?ausweis\w*|steuer-?id\w*|steuernummer|steueridentifikationsnummer|matr\w*\.?(?:-nr)?|sozialversicherung\w*)\b[^.!?;]{0,24}$",
    re.I,
)
_OTHER_CUES = frozenset(
    "award grant scholarship beca ayuda förderung order pedido bestellung invoice factura rechnung ref reference referencia isbn doi issn version page pages item sku model code error serial account tracking ticket booking lot room rooms sala salas aula aulas zimmer raum räume course kurs curso unit registered copyright © year contract contrato vertrag train charity".split()
)
_BY_CUES = frozenset(
    "by por von text texto story words written posted published edited translated author autor autora publicado veröffentlicht contact contacto ansprechperson according según laut chaired dear attn speaker witness photographs photos pictures fotos fotografías interview review".split()
)
_PERSON_VERBS = frozenset(
    "said says wrote writes told led leads joined runs directs manages teaches explained founded retired will has dijo dirige escribió explicó fundó sagte leitet schrieb erklärte gründete und and y who".split()
)

_EMAIL = re.compile(
    r"(?<![\w.+'%-])[\w.+'%-]++\s?(?:@|\[\s?at\s?\]|\(\s?at\s?\)|\{at\}|&(?:amp;)?#64;)\s?[\w-]+(?:\.[\w-]+|\s?(?:\[\s?dot\s?\]|\(\s?dot\s?\)|\{dot\})\s?[\w-]+|\sdot\s[\w-]+)+|(?<![\w.+'%-])[\w.+'%-]++\sat\s[\w-]+(?:\sdot\s[\w-]+)+",
    re.I,
)
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"(?<![\w@/])(?:\+\s?\d|\(?\d|[A-Z]{1,2}\d)[\dA-Z]*(?:[ .\-/)(]{1,2}(?:\d[\dA-Z]*|[A-Z]\b))*")
_CAPS = r"[A-ZÄÖÜÁÉÍÓÚÑ]"
_EMAIL_GATE = re.compile(r"@|#64;|[\[({]\s?at\s?[\])}]|\sat\s[\w-]+\sdot\s", re.I)
_ADDRESS = re.compile(
    rf"\b\d{{1,5}}(?:-\d{{1,5}})?[A-Z]?\s+(?:{_CAPS}[\w.'-]*\s+){{1,4}}?(?i:street|st|road|rd|avenue|ave|lane|ln|drive|court|ct|way|boulevard|blvd|place|square|terrace|close|crescent|parkway|pkwy)\b\.?(?:,\s(?i:apt|suite|unit|flat)\.?\s\w+)?" rf"|\b(?i:calle|c/|avenida|avda\.?|av\.|paseo|plaza|camino|ronda|travesía|carretera|cuesta|glorieta)\s?(?:(?i:de(?:l| la| los| las)?)\s)?(?:{_CAPS}[\w.]*,?\s(?:(?i:de(?:l| la| los| las)?)\s)?){{1,4}}(?:n[.º°]*\s?)?\d{{1,4}}\b"
)
_GERMAN_GATE = re.compile(r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|markt)\s\d", re.I)
_GERMAN_ADDRESS = re.compile(
    rf"\b(?:(?i:am|an der|an den|im|zum|zur|auf der|auf dem|in der)\s)?(?:{_CAPS}[\w-]*\s){{0,2}}{_CAPS}?[\w-]*(?i:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|markt)\s\d{{1,4}}\s?[a-z]?\b"
)
_LETTERS = [c for c in map(chr, [*range(0x41, 0x250), *range(0x1E00, 0x1F00)]) if c.isalpha()]
_UP, _LOW = "".join(c for c in _LETTERS if c.isupper()), "".join(c for c in _LETTERS if c.islower()).replace("ª", "").replace("º", "")
#: A capitalised word of any Latin script, also with a capital inside (McDonald), an apostrophe (O'Brien) or hyphens.
_CAP = rf"(?!(?:Dr|Dra|Prof|Mrs?|Ms|Sra?|Frau|Herrn?)\b)[{_UP}](?:[{_LOW}]+(?:[{_UP}][{_LOW}]+)?|['’][{_UP}][{_LOW}]+)(?:[-'’][{_UP}][{_LOW}]+(?:[{_UP}][{_LOW}]+)?)*(?!\w)"
_TITLE = r"(?:Dr|Dra|Prof|Professor|Profesora?|Mrs?|Ms|Sra?|Dean|Frau|Herrn?|Don|Doña|Dekan(?:in)?|Decan[oa])\b\.?"
_GAP = "[  \t]{1,3}"
_NAME = re.compile(
    rf"(?<!\w)(?:(?:{_TITLE}{_GAP})+(?:(?:[{_UP}]\.|{_CAP}){_GAP}){{0,2}}{_CAP}(?:{_GAP}{_CAP})?"
    rf"|(?:{_CAP}|[{_UP}]\.)(?:{_GAP}(?:[{_UP}]\.|{_CAP}|de|del|von|van|da)){{0,3}}{_GAP}{_CAP}"
    rf"|(?:[{_UP}]{{2,}}(?:['’-][{_UP}]{{2,}})*|{_CAP}),{_GAP}{_CAP}(?:{_GAP}[{_UP}]\.)?)"
)
_UPPER_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*\.?")
_WORD = re.compile(r"[^\s,;:()|]+|[,;:()|]")


class Span:
    """A candidate: offsets within its line, and the kinds it may be."""

    __slots__ = ("end", "kinds", "line", "start", "tokens")

    def __init__(self, line: int, start: int, end: int, kinds: tuple[str, ...], tokens: list[str] | None = None) -> None:
        self.line, self.start, self.end, self.kinds, self.tokens = line, start, end, kinds, tokens


def _bare(token: str) -> str:
    return token.strip(".,;:!?()[]|\"'»«•-").lower()


def _given(token: str) -> bool:
    return token in GIVEN_NAMES or any(p in GIVEN_NAMES for p in token.split("-"))


def _names_in_capitals(line: str, no: int) -> Iterator[Span]:
    """In a line of capitals every word could be a name: one starts at a given name, a title, an initial, a surname before a
    comma and a given name, or after a word that announces a person."""
    words = list(_UPPER_WORD.finditer(line))
    bare = [_bare(m.group()) for m in words]
    gap = [line[a.end() : b.start()].replace("\u00a0", " ") for a, b in zip(words, words[1:])]
    used = -1
    for i, (m, w) in enumerate(zip(words, bare)):
        if i <= used or line[m.end() : m.end() + 1] in "@[(&" and m.end() < len(line) or w in _INSTITUTION:
            continue
        comma = i < len(gap) and gap[i].strip() == "," and _given(bare[i + 1]) and w not in _COMMON and w not in GIVEN_NAMES
        initial = len(w) == 1 and m.group().endswith(".")
        if not (comma or _given(w) or w in _TITLES or initial or (i and bare[i - 1] in _BY_CUES and w not in _COMMON and len(w) > 2)):
            continue
        j = i + 1 if comma else i
        while j + 1 < len(words) and j - i < 3 and not gap[j].strip() and len(gap[j]) < 4 and (
            bare[j + 1] not in _COMMON or words[j + 1].group().endswith(".")
        ) and bare[j + 1] not in _INSTITUTION and line[words[j + 1].end() : words[j + 1].end() + 1] not in tuple("@[&"):
            j += 1
        if j > i:
            used = j
            yield Span(no, m.start(), words[j].end(), ("person_name",), bare[i : j + 1])


def _names(line: str, no: int) -> Iterator[Span]:
    if line.isupper():
        yield from _names_in_capitals(line, no)
        return
    for m in _NAME.finditer(line):
        start, tokens = m.start(), list(re.finditer(r"\S+", m.group()))
        while tokens and (first := _bare(tokens[0].group())) in _COMMON and first not in _TITLES and not tokens[0].group().endswith("."):
            tokens.pop(0)
        while tokens and _bare(tokens[-1].group()) in _COMMON:
            tokens.pop()
        if len(tokens) < 2:
            continue
        bare = [_bare(t.group()) for t in tokens]
        if tokens[0].group().endswith(",") and not tokens[0].group().isupper() and not _given(bare[1]):
            listed = line[: start + tokens[0].start()].rstrip().endswith(",") or line[m.end() :].lstrip().startswith(",")
            if listed or bare[0] in _COMMON or bare[0] in _INSTITUTION or bare[1] in _INSTITUTION:
                continue  # a list of words rather than a surname before a given name
        yield Span(no, start + tokens[0].start(), start + tokens[-1].end(), ("person_name",), bare)
        if len(tokens) > 2:  # a capitalised word beside a name may not belong to it
            for part in (slice(1, None), slice(None, -1), slice(2, None), slice(None, -2), slice(1, -1)):
                some = tokens[part]
                if len(some) >= 2 and (last := some[-1].group())[-1] != "." and last[0].isupper() and bare[part][-1] not in _TITLES and some[0].group()[0].isupper():
                    yield Span(no, start + some[0].start(), start + some[-1].end(), ("person_name",), bare[part])


def candidates(line: str, no: int) -> list[Span]:
    """Candidates of all kinds in one line."""
    out = []
    if _EMAIL_GATE.search(line):
        out += [Span(no, m.start(), m.end(), ("email",)) for m in _EMAIL.finditer(line)]
    if _DIGIT.search(line):
        for m in _NUMBER.finditer(line):
            text = m.group().rstrip(" .-/(")
            if sum(map(str.isdigit, text)) >= 6:
                out.append(Span(no, m.start(), m.start() + len(text), ("phone", "id_number")))
        out += [Span(no, m.start(), m.end(), ("street_address",)) for m in _ADDRESS.finditer(line)]
        if _GERMAN_GATE.search(line):
            out += [Span(no, m.start(), m.end(), ("street_address",)) for m in _GERMAN_ADDRESS.finditer(line)]
    out.extend(_names(line, no))
    return out


_BREAK = re.compile(r"(?<=[^\W\d_]{4})[.!?]\s")


def _context(line: str, s: Span) -> tuple[list[str], list[str]]:
    """Up to four words before and three after the span, within its sentence."""
    before, after = line[max(0, s.start - 60) : s.start], line[s.end : s.end + 40]
    ends = [m.end() for m in _BREAK.finditer(before)]
    before = before[ends[-1] :] if ends else before
    cut = _BREAK.search(after)
    return [_bare(t) for t in _WORD.findall(before)][-4:], [_bare(t) for t in _WORD.findall(after[: cut.start()] if cut else after)][:3]


def _has(tokens: list[str], cues: frozenset[str]) -> float:
    return float(any(t in cues for t in tokens))


def email_features(line: str, s: Span) -> list[float]:
    t = line[s.start : s.end]
    low = t.lower()
    at = next((i for i, p in enumerate(("@", "[", "(", "#64", "{")) if p in t), 5)
    words = [w for w in re.split(r"[^\w]+", low) if w]
    tail = words[-1] if words else ""
    return [
        float(at),
        float("." in t),
        float(" dot " in low or "[dot]" in low or "(dot)" in low),
        float(" at " in low),
        float(len(words)),
        float(len(tail)),
        float(tail.isalpha()),
        float(words[0] in _COMMON) if words else 0.0,
        float(any(c.isdigit() for c in words[0])) if words else 0.0,
        float(low.count(" ")),
        float(t == t.upper()),
        float(re.search(r"@[\w-]+(\.[\w-]+)+$", t) is not None),
        float(re.search(r"^[\w.+'%-]+\s?(?:@|\[at\]|\(at\)|&)", low) is not None),
    ]


#: Numbering plans: North American, British, French, German and Spanish numbers, at home and from abroad, by groups of digits.
_PLANS = re.compile(
    r"(?:\+?1[ .-]?)?\(?[2-9]\d\d\)?[ .-]?\d{3}[ .-]\d{4}|1?[2-9]\d\d[2-9]\d{6}|\+44 ?(?:\(0\) ?)?\d{2,5}(?: \d{3,6}){1,2}|\(?0[1-9]\d{1,4}\)?[ /-]?\d{3,8}(?:[ -]\d{1,6}){0,2}"
    r"|(?:\+33 ?|0)[1-9](?:[ .]?\d\d){4}|\+(?:49|43|41) ?(?:\(0\) ?)?\d{2,4}[ /-]?\d{3,8}(?:[ -]\d{1,6}){0,2}|(?:\+34 ?)?[6-9]\d\d(?: ?\d{3} ?\d{3}| ?\d\d \d\d \d\d)|\+\d{1,3}(?:[ .-]?\d{2,5}){2,5}"
)


def number_features(line: str, s: Span) -> list[float]:
    t = line[s.start : s.end]
    groups = re.findall(r"[\dA-Z]+", t)
    lens = [len(g) for g in groups]
    digits = sum(map(str.isdigit, t))
    left, right = _context(line, s)
    year = groups[0][:2] in ("19", "20") and lens[0] == 4
    before = line[s.start - 1] if s.start else "^"
    b2 = line[: s.start].rstrip()[-1:] or "^"
    return [
        float(_PLANS.fullmatch(t) is not None),
        float(digits),
        float(len(groups)),
        *[float(x) for x in (lens + [0] * 5)[:5]],
        float(lens[-1]),
        float(t.startswith("+")),
        float("(" in t),
        float("." in t),
        float("-" in t),
        float(" " in t),
        float(sum(c.isalpha() for c in t)),
        float(t[0].isalpha()),
        float(t[-1].isalpha()),
        float(year),
        float(year and lens[1:3] == [2, 2]),
        float(digits in (10, 11)),
        float(lens[:3] == [3, 2, 4]),
        float(lens[-2:] == [3, 4]),
        _has(left, _PHONE_CUES),
        float(_ID_PHRASE.search(line[max(0, s.start - 60) : s.start]) is not None),
        _has(left, _OTHER_CUES),
        _has(left[-2:], _PHONE_CUES),
        float(_ID_PHRASE.search(line[max(0, s.start - 26) : s.start]) is not None),
        _has(left[-2:], _OTHER_CUES),
        _has(right, _STREET),
        _has(right, frozenset(("ext", "x", "extension", "durchwahl"))),
        _has(left[-1:], frozenset(("on", "am", "el", "in"))),
        float(b2 in ":|,"),
        float(s.end >= len(line.rstrip()) - 1),
        float(before == "("),
        float("@" in line[s.end : s.end + 60]),
        float(len(line) < 90),
        float(line[s.end : s.end + 1] == ":"),
        float(line[s.end : s.end + 2] == " x" or line[s.end : s.end + 4] == " ext"),
    ]


def address_features(line: str, s: Span) -> list[float]:
    t = line[s.start : s.end]
    tokens = [_bare(x) for x in t.split()]
    left, right = _context(line, s)
    number = re.search(r"\d+", t)
    return [
        float(len(tokens)),
        float(t[0].isdigit()),
        float(t[-1].isdigit()),
        float(number is not None and len(number.group())),
        _has(tokens, _STREET),
        _has(tokens, _INSTITUTION),
        _has(tokens, _COMMON),
        _has(left, _OTHER_CUES),
        float("-" in t),
        float("," in t),
        _has(left[-2:], frozenset(("at", "to", "in", "an", "en", "address", "dirección", "anschrift", "and", "y", "und"))),
        float(line[: s.start].rstrip()[-1:] in ("|", ":", ",", "")),
        float(len(line) < 100),
        _has(right[:1], frozenset(("of", "to", "for"))),
        float(t == t.upper()),
        float(any(x.islower() and x not in ("de", "del", "la", "los", "las") for x in t.split())),
        float(tokens[-1] in _STREET if not t[-1].isdigit() else 1),
        float(1900 <= int(number.group()) <= 2035 if number and len(number.group()) == 4 else 0),
    ]


@lru_cache(maxsize=1)
def _grams() -> dict[str, float]:
    """Log odds of letter triples in listed names against words that are none; every second such word is left for training."""
    from quern.llm.pii_corpus import plain_words

    counts: list[dict[str, int]] = [{}, {}]
    for side, ws in enumerate((sorted(GIVEN_NAMES | SURNAMES), plain_words()[::2])):
        for w in ws:
            for g in _triples(w):
                counts[side][g] = counts[side].get(g, 0) + 1
    total = [sum(c.values()) + 1.0 for c in counts]
    return {
        g: float(np.log((counts[0].get(g, 0) + 0.3) / total[0]) - np.log((counts[1].get(g, 0) + 0.3) / total[1])) for g in counts[0].keys() | counts[1].keys()
    }


def _triples(word: str) -> list[str]:
    w = f"^{word}$$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


@lru_cache(maxsize=1 << 16)
def name_likeness(word: str) -> float:
    """How much more a word's letters look like those of a listed name than of other words: mean log odds of its triples, in steps."""
    table, found = _grams(), _triples(word)
    return round(4 * sum(table.get(g, 0.0) for g in found) / len(found)) / 4


def name_features(line: str, s: Span) -> list[float]:
    tokens = s.tokens or []
    left, right = _context(line, s)
    t = line[s.start : s.end]
    core = [x for x in tokens if x not in _TITLES and len(x) > 1]
    given = [x in GIVEN_NAMES or any(p in GIVEN_NAMES for p in x.split("-")) for x in core]
    after = line[s.end :].lstrip()[:1] or "$"
    return [
        float(len(tokens)),
        float(len(core)),
        float(sum(given)),
        float(bool(given) and given[0]),
        float(bool(given) and given[-1]),
        _has(tokens, _TITLES),
        float(any(len(x) == 1 for x in tokens)),
        float("," in t),
        float(t == t.upper()),
        _has(tokens, _INSTITUTION),
        _has(right[:1], _INSTITUTION),
        _has(left[-1:], _INSTITUTION),
        _has(tokens, _STREET),
        _has(right[:2], _STREET),
        _has(tokens, _COMMON),
        float(left[-1:] == ["the"]),
        _has(left[-1:], frozenset(("el", "la", "das", "der", "die", "den", "dem", "des", "ein", "eine", "einen", "the", "a", "an", "un", "una"))),
        _has(left[-2:], _BY_CUES),
        _has(left, _BY_CUES),
        _has(right[:1], _PERSON_VERBS),
        float(after in "|"),
        float(after in "-–"),
        float(after in ","),
        float(after in "("),
        float(after in ".$"),
        float(s.start < 4),
        float(s.end >= len(line.rstrip()) - 2),
        float(len(line) < 90),
        float("@" in line[s.end : s.end + 50] or "64;" in line[s.end : s.end + 50]),
        float(line[: s.start].rstrip()[-1:].isdigit()),
        float(max((len(x) for x in core), default=0)),
        float(min((len(x) for x in core), default=0)),
        _has(tokens, frozenset(("university", "universidad", "college", "universität", "hochschule"))),
        _has(right[:2], frozenset(("university", "universidad", "college", "de"))),
        float(any("-" in x for x in core)),
        float(bool(core) and core[-1] in SURNAMES),
        *(name_likeness(x) if x else 0.0 for x in (core[0] if core else "", core[-1] if len(core) > 1 else "")),
        float(sum(x[:1].islower() for x in t.split())),
    ]


_FEATURES = {
    "email": email_features,
    "phone": number_features,
    "id_number": number_features,
    "street_address": address_features,
    "person_name": name_features,
}


def is_span(s: Span, start: int, end: int) -> bool:
    """Whether a candidate is the labelled span or a part of it, give or take a word beside it."""
    shared = min(s.end, end) - max(s.start, start)
    return shared > 0.75 * min(s.end - s.start, end - start) and shared > 0.35 * max(s.end - s.start, end - start)


@lru_cache(maxsize=2)
def trained(sentences: int = TRAINING_SENTENCES, precision: float = PRECISION) -> dict[str, BoostedTrees]:
    """The trees of each kind, trained on two thirds of the made-up sentences and calibrated on the rest."""
    from quern.llm.pii_corpus import labelled_lines

    rows: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in KINDS}
    for no, (line, labels) in enumerate(labelled_lines(sentences)):
        for s in candidates(line, 0):
            for kind in s.kinds:
                x, y, held = rows[kind]
                if kind == "person_name" and any(
                    k == kind and b <= s.start and s.end <= e and not is_span(s, b, e) for k, b, e in labels
                ):
                    continue  # a small part of a name teaches nothing
                x.append(_FEATURES[kind](line, s))
                y.append(float(any(k == kind and is_span(s, b, e) for k, b, e in labels)))
                held.append(no % 3 == 0)
    out = {}
    for kind, (x, y, held) in rows.items():
        x, y, held = np.array(x), np.array(y), np.array(held)
        out[kind] = BoostedTrees(trees=100).fit(x[~held], y[~held]).calibrate(
            x[held], y[held], min(precision, NAME_PRECISION) if kind == "person_name" else precision
        )
    return out


def _longest_names(found: list[tuple[int, int, int, str, float]]) -> list[tuple[int, int, int, str, float]]:
    """Of selected names that lie within each other the longest, so that no part of a name stays."""
    names = sorted((f for f in found if f[3] == "person_name"), key=lambda f: (f[0], f[1], -f[2]))
    kept: list[tuple[int, int, int, str, float]] = []
    for f in names:
        if not (kept and kept[-1][0] == f[0] and f[2] <= kept[-1][2]):
            kept.append(f)
    return [f for f in found if f[3] != "person_name"] + kept


def select(lines: list[tuple[int, str]], models: dict[str, BoostedTrees]) -> list[tuple[int, int, int, str, float]]:
    """(place in ``lines``, start, end, kind, probability) of what is personal; overlapping spans are resolved to the likeliest."""
    found: list[tuple[int, int, int, str, float]] = []
    spans = [(i, line, s) for i, (_, line) in enumerate(lines) for s in candidates(line, i)]
    numbers: np.ndarray | None = None
    for kind in KINDS:
        mine = [(i, line, s) for i, line, s in spans if kind in s.kinds]
        if mine:
            x = numbers if kind == "id_number" and numbers is not None else np.array([_FEATURES[kind](line, s) for _, line, s in mine])
            numbers = x if kind == "phone" else numbers
            p = models[kind].probability(x)
            found += [(i, s.start, s.end, kind, float(q)) for (i, _, s), q in zip(mine, p) if q >= models[kind].threshold]
    found = _longest_names(found)
    found.sort(key=lambda f: (f[0], -round(f[4], 1), f[1] - f[2], f[1]))
    kept: list[tuple[int, int, int, str, float]] = []
    first = 0
    for f in found:
        if kept and kept[-1][0] != f[0]:
            first = len(kept)
        if all(f[2] <= k[1] or f[1] >= k[2] for k in kept[first:]):
            kept.append(f)
    return kept


def find_personal(
    pages: DataFrame,
    page_id: str = "page_id",
    text: str = "clean_content",
    sentences: int = TRAINING_SENTENCES,
    precision: float = PRECISION,
) -> DataFrame:
    """(page_id, line_no, kind): one row for each kind of personal information in a line."""
    models = trained(sentences, precision)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BATCH_TEXTS):
                part = pdf.iloc[at : at + BATCH_TEXTS]
                where, lines = [], []
                for i, t in zip(part["page_id"], part["text"]):
                    for no, line in enumerate(t.split("\n"), 1):
                        if line:
                            where.append((i, no))
                            lines.append((no, line))
                hits = dict.fromkeys((*where[f[0]], f[3]) for f in select(lines, models))
                yield pd.DataFrame(list(hits), columns=["page_id", "line_no", "kind"])

    picked = pages.where(F.col(page_id).isNotNull() & (F.length(text) > 0)).select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(text).alias("text"),
    )
    return picked.mapInPandas(run, "page_id long, line_no long, kind string").distinct()


def redact_texts(texts: list[str | None], models: dict[str, BoostedTrees]) -> list[tuple[str | None, int]]:
    """Each text with typed placeholders, and their number. Candidates of all texts are scored together."""
    split = [t.split("\n") if t is not None else [] for t in texts]
    where = [(i, no) for i, lines in enumerate(split) for no in range(len(lines))]
    found = select([(0, split[i][no]) for i, no in where], models)
    counts = [0] * len(texts)
    for at, start, end, kind, _ in sorted(found, key=lambda f: (f[0], -f[1])):
        i, no = where[at]
        split[i][no] = split[i][no][:start] + PLACEHOLDER[kind] + split[i][no][end:]
        counts[i] += 1
    return [("\n".join(lines) if t is not None else None, n) for t, lines, n in zip(texts, split, counts)]


def redact_text(text: str, models: dict[str, BoostedTrees]) -> tuple[str, int]:
    return redact_texts([text], models)[0]


def redact(pages: DataFrame, text: str = "clean_content", sentences: int = TRAINING_SENTENCES, precision: float = PRECISION) -> DataFrame:
    """All rows and columns of ``pages``, with placeholders in ``text`` and ``n_redacted`` added."""
    models = trained(sentences, precision)

    @F.pandas_udf("text string, n int")
    def run(texts: pd.Series) -> pd.DataFrame:
        held = [t if isinstance(t, str) else None for t in texts]
        done = [r for at in range(0, len(held), BATCH_TEXTS) for r in redact_texts(held[at : at + BATCH_TEXTS], models)]
        return pd.DataFrame(done, columns=["text", "n"])

    return pages.withColumn("_quern_redacted", run(F.col(text))).withColumn(text, F.col("_quern_redacted.text")).withColumn(
        "n_redacted",
        F.col("_quern_redacted.n"),
    ).drop("_quern_redacted")
