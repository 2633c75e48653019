"""Personal information inside free text (problem 10).

Method: anchor expansion. One pass of a keyword automaton (Aho-Corasick, lower case) finds the anchors: at-signs and their
disguises, cues of identity numbers and street words, titles and given names. Phone anchors are found by the same pass over
the few characters a number can begin with. At each anchor a deterministic local parser expands to both sides as far as
its grammar allows and validates what it has: the shape of an address, the digits of a number, the parts of a name.

Identity numbers behind a cue need the format of their kind; without a cue they need its check digit (Spanish DNI and NIE,
French NIR, German tax identification number).

Given names are a parameter (``GIVEN_NAMES``). Without a known given name a name is taken by structure: behind a label or verb
that takes a person ("owner:", "reported by", "please ask", "contactez"), before a verb that a person does ("approved",
"schrieb"), behind a title or sign-off, with initials behind a preposition, and beside an e-mail address made of it. The words
looked at around an anchor are counted (``_back`` and ``_ahead``), not their characters.

Defined cases: null, empty and blank texts give nothing; a mention may run over a line end, and its value keeps it; the
same mention twice is one row of the result, and both places are replaced; overlapping mentions keep the one that begins
first, the longer of two; texts are searched whole.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.catalog import spread

#: Common given names of several languages (fixed values; extend or replace by parameter).
GIVEN_NAMES = (
    "Aiko", "Aisha", "Alice", "Amina", "Ana", "André", "Anna", "Antonio", "Begoña", "Bianca", "Björn", "Callum", "Carlos", "Carmen", "Chiara",
    "Chloe", "Chloé", "Claire", "Clara", "Daniel", "David", "Diego", "Elena", "Emil", "Emma", "Erik", "Eva", "Fatima", "Felix", "Fiona", "François",
    "Greta", "Hanna", "Hannah", "Hans", "Hassan", "Henri", "Hugo", "Ines", "Inés", "Ingrid", "Isabel", "Ivan", "Jack", "James", "Jan", "Javier", "Jean",
    "Joan", "Johan", "John", "Jonas", "Jörg", "José", "Juan", "Julia", "Jürgen", "Karl", "Katarina", "Kofi", "Kwame", "Lars", "Laura", "Léa", "Leila",
    "Lena", "Liam", "Lucia", "Lucía", "Lukas", "Maria", "María", "Marie", "Marta", "Martin", "Mary", "Mateo", "Max", "Mei", "Michael", "Miguel", "Mira",
    "Mohamed", "Nadia", "Nina", "Noah", "Nora", "Olga", "Olivia", "Omar", "Oskar", "Owen", "Pablo", "Paul", "Pedro", "Peter", "Pierre", "Priya", "Rahul",
    "Ravi", "Remy", "Rosa", "Samuel", "Sara", "Sarah", "Sofia", "Søren", "Stefan", "Thomas", "Tomas", "Viktor", "Wei", "Yara", "Yusuf", "Zoe", "Zoé",
)
TITLES = ("Dr", "Mr", "Mrs", "Ms", "Mx", "Prof", "Herr", "Frau", "Mme", "M", "Sr", "Sra", "Srta", "Don", "Doña", "Madame", "Monsieur", "Señor", "Señora", "Fr", "Hr")

_WORD = r"[^\W\d_]"
_PART = rf"(?:{_WORD}[^\W\d_'’]*(?:['’]{_WORD}+)?)"
_SURNAME = re.compile(rf"(?:(?:van|von|de|del|della|da|di|du|la|le|den|der|bin|al|el)\s+)*([A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’](?!s\b)[A-ZÀ-ÖØ-Þ]?[^\W\d_]+)?(?:[-‐][A-ZÀ-ÖØ-Þ][^\W\d_]*)*)")
_INITIALS = re.compile(r"(?:[A-ZÀ-ÖØ-Þ]\.(?:-?[A-ZÀ-ÖØ-Þ]\.)*\s+)+")
_GAP = r"(?:[ \t ]+|[ \t]*\r?\n[ \t]*|[ \t]*\r[ \t]*)"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.!#$%&'*+/=?^_{|}~-")
_DOMAIN = re.compile(r"(?:[^\W_](?:(?:[^\W_]|-)*[^\W_])?\.)+[^\W\d_]{2,}")
_AT = r"\s*(?:\(\s*at\s*\)|\[\s*at\s*\]|\{\s*at\s*\}|<\s*at\s*>|\(\s*@\s*\)|\[\s*@\s*\]|\s_?at_?\s|\s+AT\s+|\s@\s)\s*"
_DOT = r"(?:\s*(?:\(\s*(?:dot|punkt|punto|point|\.)\s*\)|\[\s*(?:dot|punkt|punto|point|\.)\s*\]|\{\s*dot\s*\}|\s(?:dot|punkt|punto)\s)\s*|\.)"
_AT_HERE = re.compile(_AT, re.I)
_HIDDEN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+-")
_DOT_BACK = re.compile(rf"{_DOT}\Z", re.I)
_HIDDEN_DOMAIN = re.compile(rf"(?:[A-Za-z0-9-]+{_DOT})+[A-Za-z]{{2,}}(?![\w@])", re.I)
_SPELLED = re.compile(r"\sdot\s|[\[({]\s*(?:dot|punkt|punto|point|\.)\s*[\])}]", re.I)

#: Between groups of digits; a line end counts as a blank, as text may be wrapped inside a number.
_SEP = r"(?:\r\n|[\s.\-/])"
_PHONE = re.compile(rf"(?:(?:\+|00)[1-9]\d{{0,2}}{_SEP}?)?(?:\(0?\d{{1,5}}\){_SEP}?)?\d{{1,8}}(?:{_SEP}\(?\d{{1,8}}\)?){{0,6}}")
_GROUP = re.compile(r"\D*\d+")
#: Words before a number that make it something else than a phone number.
_NO_PHONE = re.compile(r"(?i)\b(?:range|ticket|build|release|version|port|rows?|lines?|ids?|offset|step|from|between|dated?|isbn|order|invoice|trace)[\s:#]+\Z")
_ID_CUE = (
    ("us", r"(?:social security (?:number|no\.?)|ssn)", r"\d{3}[- ]?\d{2}[- ]?\d{4}"),
    ("uk", r"(?:national insurance (?:number|no\.?)|nino|ni number)", r"[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]"),
    ("de", r"(?:steuer-?id(?:entifikationsnummer)?(?:nummer)?|steueridentifikationsnummer|idnr\.?|steuernummer|personalausweis(?:nummer)?(?: nr\.?)?|ausweisnummer)", r"[A-Z0-9]{9,11}(?![A-Za-z0-9])|\d{2} ?\d{3} ?\d{3} ?\d{3}|\d{2,3}/\d{3}/\d{4,5}"),
    ("fr", r"(?:numéro de sécurité sociale|n° de sécurité sociale|nir|carte nationale d'identité|cni)", r"[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?|[A-Z0-9]{9,12}"),
    ("es", r"(?:dni|nie|nif|documento(?: nacional)?(?: de identidad)?|tarjeta de identidad)", r"[XYZ]?-?\d{7,8}[- ]?[A-Z]"),
    ("card", r"(?:identity card|id card|tax id|tax number|carte d'identité|numéro fiscal|ausweis-nr\.?|cédula)", r"[A-Z]{0,3}\d(?:[ -]?[A-Z0-9]){6,13}"),
    ("pass", r"(?:passport (?:number|no\.?)|passport|pasaporte(?: n[.º°o]+)?|número de pasaporte|n[.º°o]+ de pasaporte|reisepass(?:nummer)?(?:[ -]nr\.?)?|passeport(?: n[.º°o]+)?|numéro de passeport)", r"[A-Z]{0,3}[- ]?\d{6,9}[A-Z]?|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}"),
)
_ID_CUE = tuple((kind, cue.replace(" ", r"\s+"), num.replace("[- ]", r"[-\s]").replace(" ?", r"\s?")) for kind, cue, num in _ID_CUE)
_IDS = [(kind, re.compile(rf"{cue}(?:\s*(?:number|no\.?|nr\.?|nummer|n[.º°]|#))?\s*(?:[:=#]|is|ist|es|est|lautet)?\s*[\"']?(?:{num})(?![\w])", re.I), re.compile(rf"(?:{num})(?![\w])", re.I)) for kind, cue, num in _ID_CUE]



def _dni(v: str) -> bool:
    d = re.sub(r"[^0-9A-Z]", "", v.upper())
    d = d.translate(str.maketrans("XYZ", "012")) if d[0] in "XYZ" else d
    return d[:-1].isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(d[:-1]) % 23] == v.upper()[-1]


def _nir(v: str) -> bool:
    d = re.sub(r"\s", "", v).upper().replace("2A", "19").replace("2B", "18")
    return len(d) == 15 and d.isdigit() and 1 <= int(d[3:5]) <= 12 and 97 - int(d[:13]) % 97 == int(d[13:])


def _steuer(v: str) -> bool:
    d = re.sub(r"\s", "", v)
    if len(d) != 11 or d[0] == "0" or sorted(d[:10].count(c) for c in set(d[:10]))[-1] not in (2, 3):
        return False
    p = 10
    for c in d[:10]:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(d[10])


#: Identity numbers that tell themselves by their check digit, without a cue.
_SELF_CHECKED = (
    (re.compile(r"(?:[XYZ][- ]?\d{7}|\d{8})[- ]?[A-Z](?![\w-])"), _dni),
    (re.compile(r"[12] ?\d{2} ?(?:0[1-9]|1[0-2]) ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3} ?\d{2}(?![\w-])"), _nir),
    (re.compile(r"\d{2} \d{3} \d{3} \d{3}(?![\w-])"), _steuer),
)
_EN_STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Lane|Ln\.?|Drive|Dr\.?|Crescent|Way|Court|Close|Terrace|Square|Place|Parkway|Row|Mews|Hill|Walk|Quay|Grove|Gardens)"
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_EN_ADDRESS = re.compile(rf"(?<![\w.,/-])\d{{1,5}}(?:[ ]?[A-Za-z])?(?:\s?[-–/]\s?\d+[A-Za-z]?)?,?{_GAP}(?:{_CAP}{_GAP}){{1,4}}{_EN_STREET}(?![\w-])")
_DE_ADDRESS = re.compile(rf"(?!(?:Muster|Um|Aus|Rück|Hin|Speicher|Arbeits)(?:weg|platz))(?:(?:Am|An der|An den|Im|In der|Auf dem|Auf der|Zum|Zur|Unter den)\s+)?[A-ZÄÖÜ][\w'’-]*?(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring|chaussee|steig|hof|markt){_GAP}\d{{1,4}}(?:\s?[a-zA-Z](?!\w))?(?:\s?[-–/]\s?\d+[a-z]?)?(?!\w)")
_DE_SPLIT = re.compile(rf"[A-ZÄÖÜ][\w'’]*(?:er|[ -][A-ZÄÖÜ]\w*)?[ -](?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ufer|Damm|Ring|Chaussee){_GAP}\d{{1,4}}(?:\s?[a-zA-Z](?!\w))?(?!\w)")
_FR_ADDRESS = re.compile(rf"(?<![\w.,/-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-Za-z])(?!\w))?,?{_GAP}(?:rue|avenue|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|square|passage|sentier|faubourg){_GAP}(?:(?:de la|de l'|de|du|des|d'|la|le|les|l'){_GAP}?)*{_CAP}(?:[ -](?:(?:de|du|des|la)[ -])?[A-ZÀ-ÖØ-Þ][\w'’-]*)*", re.I)
_ES_ADDRESS = re.compile(rf"(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Pza\.|Paseo|Camino|Carrera|Ronda|Travesía|Carretera|Glorieta|Vía){_GAP}(?:(?:de la|de los|de las|del|de|la|el|los|las){_GAP})*{_CAP}(?:{_GAP}(?:(?:de|del|la){_GAP})*{_CAP})*,?{_GAP}(?:n[.º°o]+\s?)?\d{{1,4}}(?:\s?[a-zA-Z](?!\w)|\s?(?:bis|dupl\.)(?!\w))?(?!\w)")

#: Lower-case street words, each with the parser it starts.
_AFTER_STREET = re.compile(r"[ \t]+(?!(?:in|near|before|after|and|or|at|on|is|was|are|were|the|to|for|by|from|with|until|since|next|opposite|behind|between|as|but|who|where|which|if|when|phone|tel|has|had|will|because|so|then|again|instead|tomorrow|today)\b)[a-z]{3,}")
_STREETS = {
    **dict.fromkeys(("street", "road", "avenue", "boulevard", "lane", "drive", "crescent", " way", "court", "close", "terrace", "square", " place", "parkway", " rd", " ave", " blvd", " ln", " st.", " st,", " st;", " st\n", " st\r", " st)", " st ", " st|", " dr,", " dr;", "mews", "grove", "gardens"), "en"),
    **dict.fromkeys(("straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ufer", "damm", "ring ", "chaussee", "steig"), "de"),
    **dict.fromkeys(("rue", "avenue ", "boulevard ", "place ", "chemin", "impasse", "allée", "quai", "route", "cours", "passage"), "fr"),
    **dict.fromkeys(("calle", "c/", "avenida", "avda", "plaza", "paseo", "camino", "ronda", "travesía", "carretera"), "es"),
}
#: Labels and verbs that take a person, in four languages.
_SAYS_NAME = re.compile(
    r"(?:(?:reported|tested|signed-off|reviewed|written|approved|acked|co-authored|authored|suggested|assigned|maintained|owned|led|raised|filed|fixed|merged)[ -](?:by|to):?"
    r"|(?:assignee|owner|reporter|author|maintainer|reviewer|contact|name|assigned to|cc|verfasser|autor|autora|auteur|ansprechpartner|zuständig|responsable|contacto|persona de contacto)[\"']?\s*[:=]\s*[\"']?"
    r"|(?:on call|on duty|guardia|astreinte|bereitschaft|rufbereitschaft|dienst|de permanence)\b[^:\n.]{0,24}:"
    r"|(?:please |bitte |kindly )?(?:ask|asked|asking|contact|ping|pinged|notify|tell|told|thank|thanked|thanks to|speak to|spoke to|talk to|talked to|e-?mail|call|phone|introduce|meet|met)"
    r"|(?:gemeldet|geprüft|geschrieben|freigegeben|erstellt|betreut) von|(?:fragen sie|frag|fragt|kontaktieren sie|kontaktiere|anrufen bei|dank an|wenden sie sich an)"
    r"|(?:signalé|écrit|validé|approuvé|proposé|relu) par|(?:demandez à|demander à|contactez|contacter|merci à|écrire à|appelez)"
    r"|informe de|(?:escrito|aprobado|revisado|reportado|propuesto) por|(?:pregunte a|preguntar a|contacte a|contacte con|contactar a|gracias a|llame a)"
    r"|(?:next to|beside|under) the name|aparecía)\s*\Z",
    re.I,
)
_SAYERS = (
    "by", "by:", "to:", "assignee", "owner", "reporter", "author", "maintainer", "reviewer", "contact", "name", "cc", "autor", "autora", "auteur", "verfasser", "ansprechpartner", "zuständig", "responsable", "contacto",
    "week:", "woche:", "semaine :", "semaine:", "semana:", "on call:", "on duty:", "guardia:", "astreinte:", "astreinte :", "bereitschaft:", "dienst:", "permanence :", "ask", "asked", "asking", "ping", "pinged", "notify", "tell", "told", "thank", "thanked", "thanks to", "speak to", "spoke to", "talk to", "talked to",
    "email", "e-mail", "call", "phone", "introduce", "meet", "met", "von", "fragen sie", "frag", "fragt", "kontaktieren sie", "kontaktiere", "dank an", "sich an", "bei", "par", "demandez à", "demander à", "contactez", "contacter", "merci à", "écrire à", "appelez",
    "informe de", "por", "pregunte a", "preguntar a", "contacte a", "contacte con", "contactar a", "gracias a", "llame a", "the name", "name='", "neben ", "pour ", "para ", "aparecía", "für ", "mit ", "| ", "cc ",
)
#: What persons do, behind their name.
_ACTS = (
    " approved", " wrote", " said", " says", " reported", " merged", " reviewed", " asked", " confirmed", " suggested", " replied", " noted", " agreed", " signed off", " reproduced", " complained", " volunteered",
    " schrieb", " sagte", " meldete", " bestätigte", " hat bestätigt", " hat gemeldet", " fragte", " schlug vor", " a écrit", " a signalé", " a confirmé", " a demandé", " a validé", " a proposé", " escribió", " dijo", " informó", " confirmó", " preguntó", " aprobó", " propuso",
)
#: Last words of capitalised phrases that are no surnames.
_NO_SURNAME = frozenset(
    "release version build team server service services store index queue cache router parser scanner graph module class method file project issue ticket review report meeting call board group department office system "
    "platform engine library framework database api client gateway worker node cluster pipeline job task test tests suite manager handler controller january february march april may june july august september october "
    "november december monday tuesday wednesday thursday friday saturday sunday januar februar märz mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag street road avenue".split()
)
#: Words that only hint at a person: what follows counts if it begins with an initial.
_HINTS_NAME = re.compile(r"(?:\b(?:neben|pour|para|für|de|von|for|aparecía|with|and|mit|und|y|et|von|cc)\s+|\|[ \t]*)\Z", re.I)
_INITIAL_NAME = re.compile(rf"(?:[A-ZÀ-ÖØ-Þ]\.{_GAP}?)+[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'’][A-ZÀ-ÖØ-Þ][^\W\d_]+)*")
_AFTER_CUE = re.compile(r"[\s:=\"',]*")
_NOT_NAME = frozenset("The This That These A An In On At If It We I No Yes Not And Or But For From To Der Die Das Ein Eine El La Los Las Un Una Le Les Une Il Elle Subject Re Done Main Worker Range Traceback Run See Call Please TODO CI Bitte Merci Gracias Danke Thanks Hallo Hello Hi Hola Bonjour Dear Liebe Lieber Also When While After Before Then Now Here There What Who Why How Wenn Wer Was Wie Quand Qui Cuando Quien Nous Wir Sie Ich Vous Yo Todos Alle Alles Tous Some Every Each All None Any Both Our My Your His Her Their Its".split())
_SIGN_OFF = re.compile(r"(?:thanks|thank you|regards|best regards|kind regards|cheers|best|viele grüße|mit freundlichen grüßen|gruß|saludos|un saludo|cordialement|bien à vous|merci|gracias|danke),?[ \t]*(?:\r\n|\r|\n|[ \t])[ \t]*\Z", re.I)


#: Parts of addresses that are no person's.
_ROLES = frozenset("support team info data admin sales help service services contact office hr billing security dev ops build release noreply reply platform core web mail list lists group news press legal jobs careers customer desk help helpdesk system server test user api bot docs abuse privacy marketing finance research engineering infra storage search index query graph store".split())


def _plain(word: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().replace("ß", "ss").replace("ø", "o")) if not unicodedata.combining(c))


def _ends_sentence(text: str, at: int) -> bool:
    """Whether what begins at ``at`` stands inside a longer run of capitalised words, as titles do."""
    before = text[_back(text, at, 1) : at].strip()
    return before[:1].isupper() and before[-1:].isalnum()


def _back(text: str, at: int, n: int) -> int:
    """Where the ``n`` blank-separated words before ``at`` begin."""
    for _ in range(n):
        while at and text[at - 1].isspace():
            at -= 1
        while at and not text[at - 1].isspace():
            at -= 1
    return at


def _ahead(text: str, at: int, n: int) -> int:
    """Where the ``n`` blank-separated words from ``at`` on end."""
    size = len(text)
    for _ in range(n):
        while at < size and text[at].isspace():
            at += 1
        while at < size and not text[at].isspace():
            at += 1
    return at


def _run_back(text: str, at: int, chars: frozenset[str]) -> int:
    while at and text[at - 1] in chars:
        at -= 1
    return at


class Finder:
    """Holds the automaton; ``find`` gives (start, end, kind) of all mentions, in order and without overlap."""

    def __init__(self, given_names: tuple[str, ...] = GIVEN_NAMES) -> None:
        self.given = {g.lower() for g in given_names}
        kinds: dict[str, set[str]] = {"@": {"email"}, "+": {"phone"}, "(": {"phone"}}
        for w in ("(at)", "[at]", " at ", "{at}", "<at>", "(@)", "[@]", " @ ", "( at )", "[ at ]", "_at_"):
            kinds.setdefault(w, set()).add("hidden")
        for d in "0123456789":
            kinds.setdefault(d, set()).add("phone")
        for w in ("social security", "ssn", "national insurance", "nino", "ni number", "steuer", "idnr", "personalausweis", "ausweisnummer", "numéro de sécurité", "n° de sécurité", "nir", "carte nationale", "cni", "dni", "nie", "nif", "documento", "tarjeta de identidad", "identity card", "id card", "tax id", "tax number", "carte d'identité", "numéro fiscal", "ausweis-nr", "cédula", "passport", "pasaporte", "reisepass", "passeport"):
            kinds.setdefault(w, set()).add("id")
        for w, kind in _STREETS.items():
            kinds.setdefault(w, set()).add("street_" + kind)
        for g in self.given:
            kinds.setdefault(g, set()).add("given")
        for t in _SAYERS:
            kinds.setdefault(t, set()).add("said")
        for t in _ACTS:
            kinds.setdefault(t, set()).add("acts")
        for t in ("thanks", "regards", "cheers", "grüße", "gruß", "saludos", "saludo", "cordialement", "vous", "merci", "gracias", "danke"):
            kinds.setdefault(t, set()).add("said")
        for t in TITLES:
            kinds.setdefault(t.lower() + ".", set()).add("titled")
            kinds.setdefault(t.lower() + " ", set()).add("titled")
        self.automaton = ahocorasick.Automaton()
        for w, k in kinds.items():
            self.automaton.add_word(w, (len(w), tuple(sorted(k))))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spans: set[tuple[int, int, str]] = set()
        digits_to = -1
        for end, (n, kinds) in self.automaton.iter(low):
            at = end - n + 1
            for kind in kinds:
                if kind == "phone":
                    if got := self._self_checked(text, at):
                        spans.add(got)
                    if at < digits_to:
                        continue
                    m = self._phone(text, at)
                    if m:
                        # A number may stand behind another; a run that is none goes on at its next group of digits.
                        digits_to = m[1] if m[2] else _GROUP.match(text, at).end()
                        if m[2]:
                            spans.add((m[0], m[1], "phone"))
                    continue
                if kind.startswith("street_"):
                    got = self._street(text, at, n, kind[7:])
                else:
                    got = getattr(self, "_" + kind)(text, at, n)
                if got:
                    spans.add(got)
        for start, end, kind in [x for x in spans if x[2] == "email"]:
            taken = [x for x in spans if x[2] == "name"]
            spans.update(x for x in self._beside(text, start, end) if all(x[1] <= y[0] or y[1] <= x[0] for y in taken))
        return _settle(spans)

    # -- e-mail -------------------------------------------------------------------------------------------------
    def _email(self, text: str, at: int, _: int):
        start = at
        while start and (text[start - 1] in _LOCAL or text[start - 1].isalpha()):
            start -= 1
        d = _DOMAIN.match(text, at + 1)
        if start == at or not d:
            return None
        end = d.end()
        local = text[start:at].rsplit("=", 1)[-1].lstrip("'./*=?{|}~!#$%&^-+")
        start = at - len(local)
        if not local or text[end : end + 1] == ":" and text[end + 1 : end + 2].strip() or text[end : end + 1] in ("/", "@", "-"):
            return None  # a git remote or a path
        if not local or not any(c.isalpha() for c in local) and not local.isdigit():
            return None
        return start, end, "email"

    def _hidden(self, text: str, at: int, n: int):
        start = at
        while start and text[start - 1].isspace() and at - start < 4:
            start -= 1
        m = _AT_HERE.match(text, start)
        if not m or m.end() < at + n:
            return None
        begin = self._local_back(text, start)
        domain = _HIDDEN_DOMAIN.match(text, m.end())
        if begin == start or not domain:
            return None
        if text[at : at + n].strip(" _").lower() == "at" and not _SPELLED.search(domain[0]):
            return None  # "meet at example.org" is no address
        return begin, domain.end(), "email"

    @staticmethod
    def _local_back(text: str, at: int) -> int:
        """Where a local part, whose dots may be spelled out, that ends at ``at`` begins."""
        begin = here = at
        while True:
            word = _run_back(text, here, _HIDDEN_LOCAL)
            if word == here:
                break
            begin = word
            dot = _DOT_BACK.search(text, _back(text, word, 2), word)
            if not dot:
                break
            here = dot.start()
        while begin < at and not text[begin].isalnum():
            begin += 1
        return begin

    # -- phone --------------------------------------------------------------------------------------------------
    def _phone(self, text: str, at: int):
        before = text[at - 1] if at else " "
        if before.isalnum() or before in "_.-/:#@+\\" or before == "(" and text[at] != "+" and text[at] != "0" and text[at - 2 : at - 1].isalnum():
            return None
        m = _PHONE.match(text, at)
        if not m:
            return None
        if _NO_PHONE.search(text[_back(text, at, 2) : at]):
            return at, m.end(), False
        end = m.end()
        for stop in range(end, at + 5, -1):
            cut = text[at:stop]
            if (stop == end or not text[stop].isdigit() or not text[stop - 1].isdigit()) and cut[-1].isdigit() and self._is_phone(cut):
                after = text[stop : stop + 1]
                if after and (after.isalnum() or after == "_" or after in "-/:." and text[stop + 1 : stop + 2].isalnum() or after == "," and text[stop + 1 : stop + 2].isdigit()):
                    continue
                return at, stop, True
        return at, end, False

    @staticmethod
    def _is_phone(s: str) -> bool:
        d = re.sub(r"\D", "", s)
        return any(r.fullmatch(s) for r in _PHONES) and 9 <= len(d) <= 15

    @staticmethod
    def _self_checked(text: str, at: int):
        if at and (text[at - 1].isalnum() or text[at - 1] in "_-./+#@"):
            if not (text[at - 1] in "XYZ" and (at == 1 or not text[at - 2].isalnum())):
                return None
            at -= 1
        for rx, right in _SELF_CHECKED:
            if (m := rx.match(text, at)) and right(m[0]):
                return m.start(), m.end(), "id_number"
        return None

    # -- identity numbers ---------------------------------------------------------------------------------------
    def _id(self, text: str, at: int, _: int):
        if at and (text[at - 1].isalnum()):
            return None
        for _kind, whole, number in _IDS:
            if m := whole.match(text, at):
                last = None
                for x in number.finditer(m[0]):
                    last = x if x.end() == len(m[0]) else last
                    if last:
                        break
                if last and any(c.isdigit() for c in last[0]):
                    a = m.start() + last.start()
                    return a, m.end(), "id_number"
        return None

    # -- addresses ----------------------------------------------------------------------------------------------
    def _street(self, text: str, at: int, n: int, kind: str):
        if kind == "en":
            lo = _back(text, at, 8)
            for m in _EN_ADDRESS.finditer(text, lo, min(len(text), at + n + 2)):
                if m.start() < at < m.end() and not _AFTER_STREET.match(text, m.end()):
                    return m.start(), m.end(), "address"
        elif kind == "de":
            lo, hi = _back(text, at, 5), _ahead(text, at + n, 4)
            for rx in (_DE_ADDRESS, _DE_SPLIT):
                for m in rx.finditer(text, lo, hi):
                    if m.start() <= at < m.end() and (m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_-")):
                        return m.start(), m.end(), "address"
        elif kind == "fr":
            if at and text[at - 1].isalnum():
                return None
            lo, hi = _back(text, at, 3), _ahead(text, at, 12)
            for m in _FR_ADDRESS.finditer(text, lo, hi):
                if m.start() < at < m.end() and re.search(rf"{_GAP}[A-ZÀ-ÖØ-Þ][\w'’-]*\Z", m[0]):
                    return m.start(), m.end(), "address"
        elif not (at and text[at - 1].isalnum()) and (m := _ES_ADDRESS.match(text, at)):
            return m.start(), m.end(), "address"
        return None

    # -- names --------------------------------------------------------------------------------------------------
    def _given(self, text: str, at: int, n: int):
        """A known given name, with the surname behind it, or before it in capitals and with a comma."""
        end = at + n
        if at and (text[at - 1].isalnum() or text[at - 1] in "_@.-/") or end < len(text) and (text[end].isalnum() or text[end] in "_@"):
            return None
        if not text[at].isupper() or text[at:end].isupper() and n > 2:
            return None
        back = re.search(rf"([A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'’][A-ZÀ-ÖØ-Þ][^\W\d_]+)*),{_GAP}?\Z", text[_back(text, at, 3) : at])
        if back and (back[1].isupper() or _SURNAME.fullmatch(back[1])):
            a = at - len(back[0])
            if (back[1].isupper() or self._said_before(text, a)) and not (a and (text[a - 1].isalnum() or text[a - 1] in "_@-/.")):
                stop = end
                if m := re.compile(rf"{_GAP}[A-ZÀ-ÖØ-Þ]\.(?=\W|\Z)").match(text, end):
                    stop = m.end()
                return a, stop, "name"
        return self._forward(text, at, end)

    def _forward(self, text: str, at: int, end: int):
        m = re.compile(rf"{_GAP}(?:[A-ZÀ-ÖØ-Þ]\.{_GAP})*").match(text, end)
        if not m:
            return None
        s = _SURNAME.match(text, m.end())
        if not s or len(s[1]) < 2:
            return None
        stop = s.end()
        nxt = text[stop : stop + 1]
        if nxt and (nxt.isalnum() or nxt in "_@") or nxt in (".", "-", "/") and text[stop + 1 : stop + 2].isalnum():
            return None
        if re.search(r"[a-z][A-Z]", s[1].replace("Mc", "").replace("Mac", "")) or s[1] in _NOT_NAME or s[1].lower() in _NO_SURNAME:
            return None
        gap = text[end : m.end()]
        if "\n" in gap.strip(" \t") and re.search(r"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)", gap):
            return None
        return at, stop, "name"

    def _said_before(self, text: str, at: int) -> bool:
        before = text[_back(text, at, 7) : at]
        return bool(_SAYS_NAME.search(before) or _SIGN_OFF.search(before) or re.search(r"\b(?:%s)\.?\s+\Z" % "|".join(TITLES), before))

    def _said(self, text: str, at: int, n: int):
        """A name where the text says that one follows."""
        end = at + n
        if text[end - 1].isalnum() and text[end : end + 1].isalnum():
            return None
        at = _AFTER_CUE.match(text, end).end()
        if not text[at : at + 1].isupper():
            return None
        if self._said_before(text, at):
            return self._name_at(text, at)
        if _HINTS_NAME.search(text[_back(text, at, 2) : at]) and _INITIAL_NAME.match(text, at):
            return self._name_at(text, at)
        return None

    def _acts(self, text: str, at: int, n: int):
        """A name right before what persons do."""
        end = at + n
        if not at or not text[at - 1].islower() or end < len(text) and (text[end].isalnum() or text[end] == "_") or not text[_back(text, at, 1)].isupper():
            return None
        for start in (_back(text, at, k) for k in (4, 3, 2)):
            while start < at and not text[start].isalnum():
                start += 1
            got = self._name_at(text, start)
            if got and got[1] == at and "," not in text[got[0] : at] and not _ends_sentence(text, start):
                return got
        return None

    def _beside(self, text: str, start: int, end: int):
        """Names on the line of an e-mail address whose local part is made of them: given name or initial, and surname."""
        parts = [p for p in re.split(r"[^a-z]+", _plain(re.split(r"@|[\s(\[{<]+at\b", text[start:end], maxsplit=1, flags=re.I)[0])) if p and p != "dot"]
        joined = "".join(parts)
        if len(joined) < 4 or not _ROLES.isdisjoint(parts):
            return
        left, right = max(text.rfind("\n", 0, start), text.rfind("\r", 0, start)) + 1, re.compile(r"[\r\n]|\Z").search(text, end).start()
        left, right = max(left, _back(text, start, 10)), min(right, _ahead(text, end, 10))
        for m in re.compile(r"(?<![\w@.'’/-])[A-ZÀ-ÖØ-Þ]").finditer(text, left, right):
            got = self._name_at(text, m.start())
            if not got or got[1] > right or got[0] < end and got[1] > start or "," in text[got[0] : got[1]]:
                continue
            words = [_plain(w) for w in re.findall(r"[^\W\d_]+", text[got[0] : got[1]])]
            given, surname = words[0], words[-1]
            if len(surname) > 1 and _ROLES.isdisjoint(words) and joined in (given + surname, given[0] + surname, given + surname[0], surname + given, surname + given[0], "".join(words)):
                yield got

    def _titled(self, text: str, at: int, n: int):
        if at and (text[at - 1].isalnum() or text[at - 1] in "_@.-/") or not text[at].isupper():
            return None
        m = re.compile(r"\.?[ \t]+").match(text, at + n - 1)
        return self._name_at(text, m.end()) if m else None

    _LAST_FIRST = re.compile(rf"[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'’][A-ZÀ-ÖØ-Þ][^\W\d_]+)*,{_GAP}(?:[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?(?:{_GAP}[A-ZÀ-ÖØ-Þ]\.)*|[A-ZÀ-ÖØ-Þ]\.(?:{_GAP}?[A-ZÀ-ÖØ-Þ]\.)*)")
    _FIRST_LAST = re.compile(rf"(?:[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]+)?|[A-ZÀ-ÖØ-Þ]\.)(?:{_GAP}[A-ZÀ-ÖØ-Þ]\.|(?<=\.)[A-ZÀ-ÖØ-Þ]\.)*{_GAP}(?:(?:van|von|de|del|da|di|du|la|le|den|der){_GAP})*(?:[A-ZÀ-ÖØ-Þ]['’])?[A-ZÀ-ÖØ-Þ][^\W\d_]+(?:[-'’][A-ZÀ-ÖØ-Þ][^\W\d_]+)*")

    def _name_at(self, text: str, at: int):
        for rx in (self._LAST_FIRST, self._FIRST_LAST):
            m = rx.match(text, at)
            if not m:
                continue
            nxt = text[m.end() : m.end() + 1]
            if nxt and (nxt.isalnum() or nxt in "_@") or nxt in "./-" and text[m.end() + 1 : m.end() + 2].isalnum() and nxt:
                continue
            words = re.findall(r"[^\W\d_]+", m[0])
            if any(re.search(r"[a-z][A-Z]", w) for w in words) or any(w in _NOT_NAME for w in words if len(w) > 1) or words[-1].lower() in _NO_SURNAME and len(words[-1]) > 1:
                continue
            if rx is self._LAST_FIRST and not (words[0].isupper() or words[-1].lower() in self.given or len(words[-1]) == 1):
                continue
            return m.start(), m.end(), "name"
        return None


_PHONES = [
    re.compile(p.replace("{s}", _SEP))
    for p in (
        r"(?:\+1|001|1){s}?(?:\(\d{3}\)|\d{3}){s}?\d{3}{s}?\d{4}",
        r"(?:\(\d{3}\){s}?|\d{3}{s})\d{3}{s}\d{4}",
        r"(?:\+44|0044){s}?(?:\(0\){s}?)?\d{2,4}{s}?\d{3,4}{s}?\d{3,4}",
        r"\(?0\d{2,4}\)?{s}\d{3,4}{s}?\d{3,4}",
        r"\(0\d\){s}?\d{4}{s}?\d{4}",
        r"07\d{3}{s}?\d{3}{s}?\d{3}",
        r"(?:\+49|0049){s}?(?:\(0\){s}?)?\d{2,5}{s}?\d{3,8}(?:{s}?\d{1,6})?",
        r"\(?0\d{2,5}\)?{s}{1,3}\d{3,8}(?:{s}?\d{1,6})?",
        r"(?:\+33|0033){s}?(?:\(0\){s}?)?[1-9](?:{s}?\d{2}){4}",
        r"0[1-9](?:{s}?\d{2}){4}",
        r"(?:\+34|0034){s}?[6-9]\d{2}(?:{s}?\d{3}){2}",
        r"(?:\+34|0034){s}?[6-9]\d{2}(?:{s}?\d{2}){3}",
        r"[6-9]\d{2}(?:{s}\d{3}){2}",
        r"[6-9]\d{2}(?:{s}\d{2}){3}",
        r"\+[1-9]\d{0,2}(?:{s}?\(?\d{1,4}\)?){2,5}",
    )
]


def _settle(spans: set[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identity numbers and e-mails win over what lies inside them; else the earlier, then the longer mention."""
    rank = {"email": 0, "id_number": 1, "address": 2, "phone": 3, "name": 4}
    taken: list[tuple[int, int, str]] = []  # in order, so neighbours alone can overlap
    for s in sorted(spans, key=lambda s: (rank[s[2]], s[0] - s[1], s[0])):
        i = bisect.bisect_left(taken, s[:2])
        if (i == 0 or taken[i - 1][1] <= s[0]) and (i == len(taken) or taken[i][0] >= s[1]):
            taken.insert(i, s)
    return taken


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, kind in spans:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, found array<struct<kind, value>>, redacted) of the documents with mentions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for pdf in batches:
            out = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                if spans := finder.find(t):
                    seen = dict.fromkeys((k, t[a:b]) for a, b, k in spans)
                    out.append((i, [{"kind": k, "value": v} for k, v in seen], redact(t, spans)))
            yield pd.DataFrame(out, columns=["doc_id", "found", "redacted"])

    take = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and text <> ''")
    return spread(take).mapInPandas(run, "doc_id bigint, found array<struct<kind:string,value:string>>, redacted string")


def found(docs: DataFrame) -> DataFrame:
    return mentions(docs).select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.kind", "m.value")
