"""Candidates of personal information in a text, and the labelers that vote on them.

``candidates`` proposes generously: whatever has the form of a name, a number, an
address. Each labeler then says 1 (personal), 0 (not) or -1 (nothing). What the
votes are worth is estimated later, from the corpus. Cues are general labels and
verbs; what else stands around the spans of a corpus the classifier learns.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

TYPES = ["email", "phone", "id_number", "address", "person_name"]

_S = r"(?:\r\n|[\s.\-/‐-―])"  # a separator in numbers; a line may end at any
_U = r"[^\W\d_a-zß-öø-ÿ]"  # a letter that is not a small one
_L = r"[^\W\d_]"  # a letter

# --- patterns ------------------------------------------------------------------

_LOCAL = r"[^\W_](?:[\w.+%\-]{0,63}\w)?"
_AT = r"(?:\s{0,2}@\s{0,2}|\s{0,2}[\[({<]\s?at\s?[\])}>]\s{0,2})"
_DOT = r"(?:\.|\s{0,2}[\[({<]\s?dot\s?[\])}>]\s{0,2}|\s+dot\s+)"
_LABEL = r"[^\W_](?:[\w\-]{0,62}[^\W_])?"
EMAIL = re.compile(
    rf"(?<![\w.+%\-@])(?:{_LOCAL}(?:\s{{0,2}}[\[({{<]\s?dot\s?[\])}}>]\s{{0,2}}{_LOCAL}){{0,3}}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{0,4}}{_DOT}[a-z]{{2,24}}"
    rf"|{_LOCAL}(?:\s+dot\s+{_LOCAL}){{0,3}}\s+at\s+{_LABEL}(?:\s+dot\s+{_LABEL}){{0,4}}\s+dot\s+[a-z]{{2,24}})(?![\w@]|\s+(?:at|dot)\s+[\w\-]{{1,64}}\s+dot\s)",
    re.I,
)

# In a group named ``even`` the digit groups are separated alike, or not at all.
_PHONES = {
    "north_american": rf"(?:(?:\+|00)?1{_S}?)?(?:\(\d{{3}}\){_S}?|\d{{3}}{_S}?)\d{{3}}{_S}?\d{{4}}",
    "british": rf"(?:(?:\+|00)44{_S}?(?:\(0\)\s?)?|0)(?:20{_S}?\d{{4}}{_S}?\d{{4}}|[17]\d{{3}}{_S}?\d{{6}}|1\d\d{_S}?\d{{3}}{_S}?\d{{4}})",
    "french": rf"(?:(?:\+|00)33{_S}?(?:\(0\){_S}?)?|0)[1-9](?P<even>(?:{_S}?\d\d){{4}})",
    "german": rf"(?:(?:\+|00)49{_S}?(?:\(0\){_S}?)?|\(0|0)\d{{2,4}}\)?{_S}?\d{{3,6}}(?:{_S}\d{{2,5}}|\d{{2,3}})?",
    "spanish": rf"(?:\(?(?:\+|00)34\)?{_S}?)?\d{{3}}(?:(?P<even>(?:{_S}\d\d){{3}})|{_S}?\d{{6}}|{_S}\d{{3}}{_S}\d{{3}})",
    "international": rf"\+\d{{1,3}}(?:{_S}?\(?\d{{1,7}}\)?){{2,6}}",
}
PHONES = {k: re.compile(rf"(?<![\w+(/.\-*])(?:{p})(?![\w]|[.\-/‐-―]\d)") for k, p in _PHONES.items()}

_IDS = {
    "nine_digits": rf"(?P<even>\d{{3}}{_S}?\d\d{_S}?\d{{4}})",
    "letter_digits": r"[A-Z]{1,2}\d{6,13}",
    "letter_groups": r"[A-Z]\d{3}-\d{4}-\d{4}-\d{2}",
    "eleven_digits": rf"(?P<even>\d\d{_S}?\d{{3}}{_S}?\d{{3}}{_S}?\d{{3}})",
    "fifteen_digits": rf"(?P<even>\d{_S}?\d\d{_S}?\d\d{_S}?\d\w{_S}?\d{{3}}{_S}?\d{{3}}(?:{_S}?\d\d)?)",
    "digits_letter": r"(?:[XYZ]-?)?\d{1,2}\.?\d{3}\.?\d{3}-?[A-Z]",
    "other": r"(?=[A-Z]*\d)[A-Z\d](?:[A-Z\d]|[ .\-](?=[A-Z\d])){5,20}",
}
IDS = {k: re.compile(rf"(?<![\w*.\-])(?:{p})(?![\w]|[.\-‐-―]\d)") for k, p in _IDS.items()}
# A number without its area or country code, as it may stand right behind a label; its groups are separated alike.
LOCAL_PHONE = re.compile(rf"(?:\(?0\d{{1,4}}\)?{_S}?)?\d{{2,8}}(?:(?P<sep>{_S})\d{{2,5}}(?:(?P=sep)\d{{2,5}}){{0,2}})?(?![\w]|[.\-/‐-―]\d)")
_EVEN = {"french": (4,), "spanish": (3,), "nine_digits": (2,), "eleven_digits": (3,), "fifteen_digits": (5, 6)}


def _even(form: str, m: re.Match) -> bool:
    """Are the digit groups of a match separated alike or not at all; a line's end counts as a space."""
    if form not in _EVEN or m["even"] is None:
        return True
    found = [" " if x.isspace() else x for x in re.findall(_S, m["even"])]
    return not found or (len(found) in _EVEN[form] and len(set(found)) == 1)


_UNIT = r"(?:(?:Apt|Apartment|Unit|Suite|Ste|Fl|Floor|Rm|Room)\.?\s+\w{1,5})|#\s?\w{1,5}"
_TOWN = rf"{_U}[\w'’]+(?:[\s\-]+{_U}[\w'’]+){{0,3}}"
_STREETS = r"Avenue|Ave|Boulevard|Blvd|Court|Ct|Drive|Dr|Highway|Hwy|Lane|Ln|Place|Pl|Road|Rd|Square|Sq|Street|St|Terrace|Ter|Trail|Way|Circle|Cir|Parkway|Pkwy"
_HOUSE = r"\d{1,6}(?:-?[A-Z])?(?:\s+1/2)?"
_BOX = r"(?i:P\.?\s?O\.?|Post\s+Office)\s+(?i:Box)\s+\d{1,6}"
_GAP = r"(?:,\s*|\s*\n\s*|\s+)"
_TOWN_PART = rf"{_U}[\w'’]+(?:-[\w'’]+){{0,4}}"
_TOWN_SMALL = r"(?:am|an|auf|aux?|bei|ob|vor|im|in|der|dem|den|de|del|des|du|d|di|la|las|le|les|el|los|lès|lez|sur|sous|en|et|y|i)"
# Further words of a town stand on its line; a label, as before a colon or of a number, is none.
_TOWN_EU = rf"{_TOWN_PART}(?:[^\S\n\r]+(?:{_TOWN_SMALL}[^\S\n\r]+|[dlDL]['’])*(?!(?:Tel|Tél|Fax|Phone|Telefon|Teléfono|Téléphone|Mobil|Móvil|E-?[Mm]ail|Email|Mail)\b){_TOWN_PART}(?![\w'’\-]|\s*[:@])){{0,5}}"
_ADJECTIVE = r"(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Hohe|Lange|Breite)[rsn]?\s+)"
ADDRESSES = {
    "american": re.compile(
        rf"(?<![\w\-/.])(?:{_BOX}|{_HOUSE}\s+(?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?\s+)?(?:{_U}[\w'’\-]*\s+){{1,4}}?(?:{_STREETS})\b\.?)"
        rf"(?:,?\s+(?:{_UNIT}))?{_GAP}{_TOWN},?\s+[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?(?![\w\-])"
    ),
    "french": re.compile(
        rf"(?<![\w\-/.])\d{{1,5}}(?:\s+(?:bis|ter|quater))?,?\s+(?i:rue|avenue|av\.|boulevard|bd\.?|chemin|impasse|place|quai|allée|cours|route|square|passage)\s+"
        rf"[^\d\n,;:]{{2,50}}(?:\n[^\d\n,;:]{{1,30}})?,\s+\d{{5}}\s+{_TOWN_EU}"
    ),
    "german": re.compile(
        rf"(?<![\w\-/.])(?:{_ADJECTIVE}?(?:(?:Am|An|Auf|Im|In|Zum|Zur)\s+(?:der\s+|dem\s+)?{_U}[\w\-]+|{_U}[\w\-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring))"
        rf"|(?:{_U}[\w\-]+[^\S\n]+)?{_U}[\w\-]+\s+(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ufer|Damm|Ring))"
        rf"\s+\d{{1,4}}(?:\s?[a-z])?,\s+\d{{5}}\s+{_TOWN_EU}"
    ),
    "spanish": re.compile(
        rf"(?<![\w\-/.])(?:Calle|C/|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Pº|Camino|Ronda|Travesía|Carretera|Ctra\.?)\s+[^\d\n;:]{{2,50}}?(?:\n[^\d\n;:]{{1,30}}?)?,?\s+(?:n\.?º\s*|núm\.?\s*)?\d{{1,4}}"
        rf"(?:,\s+(?:\d{{1,2}}\.?[ºª°]\s*\w{{0,4}}|bajo(?:\s\w)?|ático|entlo\.?|pral\.?|\w{{1,6}}))?,\s+\d{{5}}\s+{_TOWN_EU}"
    ),
}

_PARTICLE = r"(?:di|de\s+la|de\s+los|del|de|da|dos|du|van\s+der|van\s+den|van|von\s+der|von|la|le|af|ten|ter)"
_PARTICLE_STARTS = "advlt"
_PARTICLES = set("di de la los del da dos du van der den von le af ten ter".split())
_INNER_PARTICLE = re.compile(rf"(?:\w+\s+)?{_PARTICLE}\s+")
_WORD = rf"(?:{_U}\w+|{_U}['’]{_U}\w+)(?:['’]{_U}\w+)?"
_FAMILY = rf"(?:{_PARTICLE}\s+)?{_WORD}(?:-{_WORD})*"
_GIVEN = rf"(?:{_WORD}(?:-{_WORD})?|{_U}\.(?:\s?{_U}\.)?)(?:\s+{_U}\.)?"
_GAP1 = r"(?:[^\S\n]*\n?[^\S\n]*(?<=\s))"
#: A word that a title or a name may begin with; a name doesn't begin after one of NOT_BEFORE_NAMES.
WORD_START = re.compile(rf"{_U}(?<![\w'’].)[\w.'’]*")
NOT_BEFORE_NAMES = frozenset("@/-")
FULL_NAME = re.compile(rf"({_GIVEN}{_GAP1}{_FAMILY})(?![\w@])")
REVERSED = re.compile(rf"(?<![\w'’@/\-])(?=({_FAMILY},[^\S\n]?\n?{_WORD}(?:-{_WORD})?(?:[^\S\n]+{_U}\.)?)(?![\w@]))")
_SMALL = rf"{_L}+(?:['’\-]{_L}+)*"
SMALL_NAME = rf"{_SMALL}(?:\s+{_L}\.)?\s+(?:{_PARTICLE}\s+)?{_SMALL}"

# Titles before a family name, without their full stop.
TITLES = set(
    "Mr Mrs Ms Miss Dr Prof Professor Atty Hon Herr Herrn Frau Fräulein Monsieur Madame Mademoiselle M MM Mme Mmes Mlle Me Maître Sr Sra Srta Señor Señora Señorita Don Doña Dña".split()
)
TITLED = re.compile(rf"\w+\.?\s+({_FAMILY})(?![\w@])")

# --- cues ----------------------------------------------------------------------

# What stands before a person's name.
NAME_BEFORE = re.compile(
    r"(?<!\w)(?:(?:witness list|attn|attention|prepared by|name|affiant|declarant|deponent|witness|signed|reviewed by|filed by|submitted by|drafted by|contact person|contact|author|client|patient|tenant|sender|recipient|owner|employee|manager|applicant|beneficiary|ansprechpartner|autor|auteur|cliente?|testigo|témoin|zeuge|zeugin|verfasser|nom|nombre|nombre y apellidos)\s*:"
    r"|signed by|prepared by|questioned|interviewed|thanked|respectfully submitted,|sincerely,|regards,|according to|met with|spoke with|this is|i am|my name is|ich heiße|mein name ist|mi nombre es|me llamo|je m['’]appelle|je suis|rédigé par|signée? par|bearbeitet von|unterzeichnet von|gezeichnet von|unterschrieb|firmó la declaración|firmad[oa] por|redactad[oa] por|elaborado por|agréer nos salutations\.|cordialement,|mit freundlichen grüßen,?|atentamente,|hochachtungsvoll,?)\s*",
    re.I,
)
SIGNATURE_BEFORE = re.compile(r"(?:^|\n)--[^\S\n]*\r?\n[^\S\n]*$")
# What stands after a person's name.
NAME_AFTER = re.compile(
    r"(?:['’]s?\s+(?:affidavit|declaration|deposition|testimony|statement|letter)|\s+(?:testified|explained|declared|stated|swore|deposed|said|says|wrote|asked|replied|signed|objected|argued|met|declaró|dijo|firmó|déclare|déclara|affirme|erklärte|sagte|schrieb)\b"
    r"|\s*[(,;]\s*(?:ssn|social\s+sec|soc\.|tin\b|taxpayer|passport|driver|operator|dl\s+no|travel\s+doc|dni|nif|nie\b|documento\s+de|nir\b|n°\s+de|numéro\s+de|steuer|idnr)"
    r")",
    re.I,
)
# Words of firms, bodies, courts, places and documents.
ORGANISATION = (
    "Agency Association Authority Bank Board Bureau Church Co College Commission Committee Company Cooperative Corp Corporation Council County Court Department District Foundation "
    "Group Hospital Inc Institute LLP LLC Line Ltd Ministry Office Partners School Society Trust Union University AG GmbH SA SARL SL"
).split()
STRONG_ORGANISATION = set("Association Authority Board Commission Committee Company Cooperative Corporation Council County Department District LLP LLC Ltd Inc Trust Union University GmbH".split())
ORGANISATION_AFTER = re.compile(rf"(?:[^\S\n]+&|(?:,?[^\S\n]+{_U}[\w'’]+){{0,2}},?[^\S\n]+(?:{'|'.join(ORGANISATION)})(?!\w))")
CAPTION = re.compile(r"(?:(?<!\w)v\.?\s+|(?<!\w)(?:See|see|Voir|Vgl\.|Véase|contra|anders|Cf\.|firm|Firma|sociedad|société)\s+|&\s+)$")
# Words that open sentences and headings rather than names.
NOT_NAMES = set(
    "a all alternative amicus an analogy analysis and another any appendix argument as at bar batch but by canon certification conclusion concession counterargument "
    "definition deference der des die das docket dossier el en engine even exhibit fact factor first folio for form from harm he headings her his hypothetical if im in "
    "index invoice issue it judge jury juror la le legislative les line los my no nothing notice on one oral our pièce parcel policy preservation procedural rebuttal record "
    "redact relief remedy reply route rule section see she standard state summary table tab that the their there they this to total transcript transition un under une "
    "waiver we what when where which who will with without write you your beleg aktenzeichen autos version randnummer voir vgl véase steuerliche identifikationsnummer "
    "atentamente cordialement sincerely respectfully hochachtungsvoll saludos anschrift adresse domicilio address phone mail email tel fax ext return counsel court security social taxpayer passport number license licence".split()
)

# Family names that are words of places, buildings, law and trade as well; alone they speak for no person.
ORDINARY = set(
    "bank bay bishop bond bridge brief brook cask chapel church court cross dale falls ferry field ford forest gate glen green grove hall harbor harbour heath hill hills house "
    "island judge justice king knight lake lane law major marsh meadow mill mills moor mount orchard page parish park point pond pool port price ridge river rock shore spring "
    "square stone street temple timber tower town vale valley wall ward water waters well wells wood woods".split()
)

PHONE_BEFORE = re.compile(
    r"(?<!\w)(?:tel|tél|phone|telephone|téléphone|telefon|teléfono|telefonisch|mobile|cell|fax|voice|callback|reached\s+at|reach\s+(?:me|us|him|her|them)\s+(?:at|on)|ring\s+(?:me|us)\s+(?:at|on)|call\s+me\s+on|call|kontakt|joignable\s+au|appeler\s+le|rappeler\s+le|unter|rufen|llamar\s+al|ruf)\s*[.:]*\s*:?\s*",
    re.I,
)
LINE_START = re.compile(r"(?:^|[\n|])[^\S\n]*$")
LINE_END = re.compile(r"[^\S\n]*(?:\r?\n|$|\|)")
# Labels of numbers that belong to no person.
OTHER_NUMBER = re.compile(
    r"(?<!\w)(?:index|exhibit|parcel|form|batch|bar\s+no|docket\s+no|docket|invoice|folio|pièce|beleg\s+nr|beleg|aktenzeichen|autos\s+n\.?º|dossier\s+n°|dossier|article|artikel|version|build|commit|item|tab|no\.|masked\s+as|case\s+no|claim\s+no|policy\s+no|receipt|ticket|order|page)\s*[.:#]*\s*",
    re.I,
)
# Labels of a person's numbers.
ID_BEFORE = re.compile(
    r"(?<!\w)(?:ssn|my\s+social|social\s+security(?:\s+(?:number|no\.?))?|soc\.\s+sec\.\s+(?:no\.?|number)|tin|taxpayer\s+id(?:entification)?(?:\s+(?:number|no\.?))?|itin|passport(?:\s+(?:no\.?|number))?|passeport(?:\s+n°)?|pasaporte(?:\s+n\.?º)?|reisepass(?:-?nr\.?)?|"
    r"travel\s+document(?:\s+(?:no\.?|number))?|driver['’]?s['’]?\s+licen[sc]e(?:\s+(?:no\.?|number))?|operator['’]?s['’]?\s+licen[sc]e(?:\s+(?:no\.?|number))?|driving\s+licence|dl\s+no\.?|führerschein(?:-?nr\.?)?|permis\s+de\s+conduire|"
    r"national\s+(?:id|identity)(?:\s+(?:no\.?|number|card))?|identity\s+(?:card|number)|personalausweis(?:-?nr\.?)?|steuer-?id(?:-?nr\.?)?|idnr\.?|steuerliche\s+identifikationsnummer|identifikationsnummer|sozialversicherungsnummer|"
    r"nir|(?:n°|numéro|no)\s+de\s+s[ée]cu(?:rité\s+sociale)?|sécurité\s+sociale|dni|nif|nie|documento\s+(?:nacional\s+)?de\s+identidad|número\s+de\s+identidad)"
    r"\s*(?:(?:is|ist|est|es|lautet)(?!\w))?\s*[:#]?\s*",
    re.I,
)
STREET_BEFORE = re.compile(
    r"(?:address|anschrift|adresse|domicilio|resides\s+at|liv(?:es|ed|ing)\s+(?:at|in)|premises\s+at|wohnt|wohnhaft|demeure|demeurant|habite(?:\s+au)?|vive\s+en|con\s+domicilio\s+en|\)|,)\s*[,:]?\s*$", re.I
)

EMAIL_BEFORE = re.compile(
    r"(?<!\w)(?:e-?mail|mailto|contact|contact\W{1,4}|cc|write\s+to|send\s+(?:it\s+)?to|copy\s+to|copie\s+à|copia\s+a|kopie\s+an|écrire\s+à|escribir\s+a|schreiben\s+(?:sie\s+)?an)\s*[:<=\"'(]*\s*",
    re.I,
)
# What has the look without the substance; such candidates teach what is none.
_ROUGH_EMAIL = re.compile(r"(?<![\w.+%\-@])[\w.+%\-]{1,64}\s?@\s?\w[\w.\-]{0,63}\w")
_MEASURE = re.compile(r"@\s?(?:\d+(?:[.,]\d+)?\s?(?:in|cm|mm|pt|px|%)?(?!\w)|commit\b|[0-9a-f]{7,40}(?!\w))")
_BREAK = r"(?:[^\S\r\n]+|[^\S\r\n]*\r?\n[^\S\r\n]*)"  # spaces, or one line's end
_ROUGH_ADDRESS = re.compile(
    rf"(?<![\w\-/.])\d{{1,6}}[A-Za-z]?{_BREAK}(?:[\w'’\-]+{_BREAK}){{1,5}}?(?:{_STREETS})(?!\w)\.?(?P<town>(?:,\s*|\s+in\s+){_U}(?:{_L}|['’])+(?:[ \-]{_U}(?:{_L}|['’])+(?!\d)){{0,3}}(?:,?\s+(?:[A-Z]{{1,2}}\d[A-Z\d]?\s?\d[A-Z]{{2}}|[A-Z]{{2}}\s+\d{{5}}))?(?!\w))?"
)

# Where to look: groups of digits, at signs and capitals after commas.
_GROUP = re.compile(r"\d+")
_BETWEEN = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "()+.-/" + "".join(map(chr, range(0x2010, 0x2016)))
_ISO_DATE = re.compile(r"\d{4}-\d\d-\d\d")
_DATE = re.compile(r"\d{4}-\d\d-\d\d|\d\d?([./-])\d\d?\1\d{4}")
_AT_SIGN = re.compile(r"@|[\[({<]\s?at\s?[\])}>]|\sat\s+[\w\-]{1,64}\s+dot\s", re.I)
_COMMA = re.compile(rf",[^\S\n]?\n?{_U}")


def _digit_runs(text: str) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Runs of digit groups with only separators between, as (start, end, digits) of five digits or more, and the groups of five."""
    runs, fives = [], []
    start = end = n = 0
    for m in _GROUP.finditer(text):
        a, b = m.span()
        if b - a == 5:
            fives.append(a)
        if n and a - end < 6 and not text[end:a].strip(_BETWEEN):
            end, n = b, n + b - a
        else:
            if n > 4:
                runs.append((start, end, n))
            start, end, n = a, b, b - a
    if n > 4:
        runs.append((start, end, n))
    return [r for r in runs if not _ISO_DATE.fullmatch(text, r[0], r[1])], fives


# The last words of the cues before a name; a colon may end others.
_CUE_ENDS = set("to with thanked interviewed regards, heiße ist es llamo m'appelle m’appelle appelle suis by von par por questioned is am unterschrieb declaración grüßen grüßen, submitted, sincerely, salutations. cordialement, atentamente, hochachtungsvoll hochachtungsvoll,".split())


def _cued(text: str, at: int) -> bool:
    """Does a cue for a name end right here?"""
    last = text[max(0, at - 24) : at].split()[-1:]
    return bool(last) and (last[0][-1] == ":" or last[0].lower() in _CUE_ENDS) and _follows(NAME_BEFORE, text, at)


def _follows(pattern: re.Pattern, text: str, at: int) -> bool:
    """Does a match of the pattern end right here?"""
    return any(m.end() == at for m in pattern.finditer(text, max(0, at - 60), at))


# The last words of the labels of a person's numbers, and of what may stand between them and a number.
_ID_ENDS = tuple(
    "ssn social security number no no. tin id identification itin passport passeport n° n.º nº pasaporte reisepass nr nr. document licence license führerschein conduire card identity "
    "personalausweis idnr idnr. nummer nir sécu secu sociale dni nif nie identidad is ist est es lautet".split()
)


def _labelled(text: str) -> Iterator[int]:
    """Where a number may begin, capitals and digits mixed, that stands right behind a label of a person's numbers."""
    last = -1
    for m in _GROUP.finditer(text):
        at = m.start()
        while at and "A" <= text[at - 1] <= "Z":
            at -= 1
        if at > last and text[max(0, at - 60) : at].rstrip().rstrip(":#").rstrip().casefold().endswith(_ID_ENDS) and _follows(ID_BEFORE, text, at):
            yield at
        last = at


def _windows(places: list[int], before: int, after: int, size: int) -> list[tuple[int, int]]:
    """Stretches around places, those that touch joined."""
    out: list[tuple[int, int]] = []
    for at in places:
        low, high = max(0, at - before), min(size, at + after)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


@dataclass
class Candidate:
    """A span that may be personal, with the labelers' votes and the classifier's features."""

    pii_type: str
    start: int
    end: int
    votes: tuple[int, ...] = ()
    features: list[int] = field(default_factory=list)


#: Names of the votes of each type, in their order. No vote is the same as another or its contrary.
LABELERS = {
    "email": ["form", "at_sign", "cue_before", "measure"],
    "phone": ["cue_before", "own_line", "form", "other_label", "digits"],
    "id_number": ["cue_before", "form", "other_label", "person_before"],
    "address": ["form", "cue_before", "ends_here", "other_label"],
    "person_name": ["cue_before", "cue_after", "given_known", "family_known", "organisation", "not_a_name"],
}
FEATURE_BITS = 14


@lru_cache(1 << 16)
def feature(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1)


_DIGITS = str.maketrans("0123456789", "9999999999")


def _context(text: str, start: int, end: int) -> list[str]:
    """What stands around a span: two words before it and two behind."""
    before, after = text[max(0, start - 30) : start].lower(), text[end : end + 24].lower()
    if _GROUP.search(before):
        before = before.translate(_DIGITS)
    if _GROUP.search(after):
        after = after.translate(_DIGITS)
    b, a = before.split()[-2:], after.split()[:2]
    glued = "" if not before or before[-1].isspace() else before[-1]
    line = "^" if not before.strip(" \t") or before.rstrip(" \t")[-1:] == "\n" else ""
    return ["b:" + " ".join(b), "b1:" + (b[-1] if b else ""), "a:" + " ".join(a), "a1:" + (a[0] if a else ""), f"g:{glued}{line}|{after[:1]}"]


def _form_of(text: str) -> str:
    """A span's characters by class, runs cut to one letter and digits to four."""
    classes = ("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c for c in text[:40])
    return re.sub(r"a+", "a", re.sub(r"A{2,}", "AA", "".join(classes)))


@dataclass
class _Words:
    """What the words of a name's candidate tell, wherever it stands."""

    given: bool
    family: bool
    bad: bool
    organisation: bool
    behind: int  # where the words behind a particle begin, which may be a cue's preposition; 0 without one
    features: list[int]


class Finder:
    """Candidates with their votes; ``given`` and ``family`` are the gazetteer's names in small letters."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = given, family
        self._known: dict[tuple[str, str], _Words | None] = {}

    def __getstate__(self) -> dict:
        return {"given": self.given, "family": self.family, "_known": {}}

    def candidates(self, text: str) -> list[Candidate]:
        """All candidates of a text, in no order; spans may overlap."""
        runs, fives = _digit_runs(text)
        out = self._emails(text) + self._phones(text, runs) + self._ids(text, runs) + self._addresses(text, fives) + self._names(text)
        for c in out:
            c.features += [feature(f"{c.pii_type}:{w}") for w in _context(text, c.start, c.end)]
            c.features.append(feature(c.pii_type))
        return out

    def _emails(self, text: str) -> list[Candidate]:
        found: dict[tuple[int, int], int] = {}
        # The parts of an address are at most 64 characters long each.
        for low, high in _windows([m.start() for m in _AT_SIGN.finditer(text)], 320, 480, len(text)):
            for m in EMAIL.finditer(text, low, high):
                found[m.span()] = 1
            for m in _ROUGH_EMAIL.finditer(text, low, high):
                found.setdefault(m.span(), 0)
        out = []
        for (a, b), form in found.items():
            votes = (
                form,
                1 if "@" in text[a:b] and " " not in text[a:b] else -1,
                1 if _follows(EMAIL_BEFORE, text, a) else -1,
                0 if _MEASURE.search(text, a, b) else -1,
            )
            out.append(Candidate("email", a, b, votes, [feature(f"email:f:{_form_of(text[a:b])}"), feature(f"email:d:{text[a:b].rpartition('.')[2].lower()}")]))
        return out

    def _phones(self, text: str, runs: list[tuple[int, int, int]]) -> list[Candidate]:
        found: dict[tuple[int, int], str] = {}
        starts = set()
        for low, high, n in runs:
            first = low - (text[low - 1 : low] == "(")
            for form, pattern in PHONES.items() if n > 8 or text[low - 1 : low] == "+" else ():
                for m in pattern.finditer(text, max(0, low - 3), min(len(text), high + 2)):
                    if _even(form, m) and not (form == "international" and m.start() in starts):
                        found.setdefault((m.start(), m.end()), form)
                        starts.add(m.start())
            if first not in starts and (n > 6 or _follows(PHONE_BEFORE, text, first)) and (m := LOCAL_PHONE.match(text, first)):
                found.setdefault(m.span(), "local")
        out = []
        for (a, b), form in found.items():
            digits = sum(ch.isdigit() for ch in text[a:b])
            cue = _follows(PHONE_BEFORE, text, a)
            if digits < 5:
                continue
            own = 1 if LINE_START.search(text[max(0, a - 40) : a]) and LINE_END.match(text, b) else -1
            bare = text[a:b].isdigit()
            strong = form not in ("german", "local") and not (bare and digits == 9) or form == "german" and text[a:b].startswith(("+49", "0049"))
            other = _follows(OTHER_NUMBER, text, a) or _follows(ID_BEFORE, text, a) or _DATE.fullmatch(text, a, b)
            votes = (1 if cue else -1, own, 1 if strong else -1, 0 if other else -1, 0 if digits > 15 else -1)
            out.append(Candidate("phone", a, b, votes, [feature(f"phone:form:{form}"), feature(f"phone:f:{_form_of(text[a:b])}")]))
        return out

    def _ids(self, text: str, runs: list[tuple[int, int, int]]) -> list[Candidate]:
        found: dict[tuple[int, int], str] = {}
        for low, high, n in runs:
            for form, pattern in IDS.items() if n > 5 else ():
                if form == "other":
                    continue
                # A number ends at most so far after its run's end (a letter and seven digits in groups).
                for m in pattern.finditer(text, max(0, low - 3), high + 24):
                    if m.start() < high and _even(form, m):
                        found.setdefault((m.start(), m.end()), form)
        for at in _labelled(text):
            if m := IDS["other"].match(text, at):
                found.setdefault(m.span(), "other")
        out = []
        for (a, b), form in found.items():
            cue = 1 if form == "other" or _follows(ID_BEFORE, text, a) else -1
            other = 0 if _follows(OTHER_NUMBER, text, a) or _follows(PHONE_BEFORE, text, a) else -1
            person = any(w in self.given or w in self.family for w in re.findall(rf"{_L}+", text[max(0, a - 60) : a].lower()))
            form_vote = 1 if form not in ("other", "nine_digits", "eleven_digits", "letter_digits") else -1
            out.append(Candidate("id_number", a, b, (cue, form_vote, other, 1 if person else -1), [feature(f"id:form:{form}"), feature(f"id:f:{_form_of(text[a:b])}")]))
        return out

    def _addresses(self, text: str, postcodes: list[int]) -> list[Candidate]:
        found: dict[tuple[int, int], str] = {}
        for low, high in _windows(postcodes, 240, 200, len(text)):
            for form, pattern in ADDRESSES.items():
                for m in pattern.finditer(text, low, high):
                    found.setdefault(m.span(), form)
        for m in _ROUGH_ADDRESS.finditer(text):
            found.setdefault(m.span(), "rough" if m["town"] is None else "town")
        out = []
        for (a, b), form in found.items():
            full = {"rough": 0, "town": -1}.get(form, 1)
            cue = STREET_BEFORE.search(text[max(0, a - 30) : a]) or LINE_START.search(text[max(0, a - 5) : a])
            ends = text[b : b + 1] in ".,;)\n\r|" or text[b : b + 2].isspace()
            other = _follows(OTHER_NUMBER, text, a)
            out.append(Candidate("address", a, b, (full, 1 if cue else -1, 1 if ends else -1, 0 if other else -1), [feature(f"address:form:{form}")]))
        return out

    def _names(self, text: str) -> list[Candidate]:
        found: dict[tuple[int, int], str] = {}
        for word in WORD_START.finditer(text):
            at = word.start()
            if word[0].rstrip(".") in TITLES and text[at - 1 : at] != "." and (m := TITLED.match(text, at)):
                found[m.span(1)] = "titled"
            # A name goes on with a capital or a particle, so most words need no closer look.
            behind = text[word.end() : word.end() + 4].lstrip()[:1]
            if behind.islower() and behind not in _PARTICLE_STARTS or text[at - 1 : at] in NOT_BEFORE_NAMES:
                continue
            if m := FULL_NAME.match(text, at):
                found.setdefault(m.span(1), "full")
        for low, high in _windows([m.start() for m in _COMMA.finditer(text)], 120, 120, len(text)):
            for m in REVERSED.finditer(text, low, high):
                found.setdefault(m.span(1), "reversed")
        if "his is" in text or "name is" in text or "--" in text:
            for m in _SMALL_PLACES.finditer(text):
                found.setdefault(m.span(1), "small")
        out, listed = [], {}
        for (a, b), form in sorted(found.items()):
            # In a list, what holds for a name holds for the one behind the semicolon.
            in_list = text[a - 2 : a] == "; " and listed.get(a - 2, False)
            c = self._name(text, a, b, form, in_list)
            if c is not None:
                out.append(c)
                listed[b] = listed.get(b, False) or c.votes[0] == 1
        return out

    def _family(self, name: str) -> bool:
        """Is it, or a part of it, a known family name?"""
        return name in self.family or ("-" in name and any(p in self.family for p in name.split("-")))

    def _told(self, span: str, form: str) -> _Words | None:
        """What a candidate's words tell, None if they are no name's; kept for the next time."""
        key = (span, form)
        if key not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[key] = self._read(span, form)
        return self._known[key]

    def _read(self, span: str, form: str) -> _Words | None:
        words = [w for w in re.split(r"[\s,]+", span) if w]
        plain = [w for w in words if not w.endswith(".")]
        names = [w.lower() for w in plain if w not in _PARTICLES]
        if not names or (form != "titled" and words[0].rstrip(".") in TITLES and not (words[0].endswith(".") and len(words) > 2)):
            return None
        first, last = (names[-1], names[0]) if form == "reversed" else (names[0], names[-1])
        initials = form != "titled" and len(words) > len(plain) and len(names) == 1
        bad = any(w in NOT_NAMES and w not in self.given and w not in self.family for w in names) or (form in ("full", "small") and names[0] in NOT_NAMES)
        told = [f"form:{'initials' if initials else form}", f"n:{len(words)}", f"first:{first}", f"last:{last}", f"f:{_form_of(span)}"]
        told += [f"end:{first[-2:]}", f"end:{last[-3:]}"]
        return _Words(
            given=form != "titled" and first in self.given,
            family=self._family(last) and (last not in ORDINARY or initials),
            bad=bad,
            organisation=form != "small" and any(w in STRONG_ORGANISATION for w in plain),
            behind=m.end() if (m := _INNER_PARTICLE.match(span)) else 0,
            features=[feature(f"person_name:{w}") for w in told],
        )

    def _name(self, text: str, a: int, b: int, form: str, in_list: bool) -> Candidate | None:
        told = self._told(text[a:b], form)
        if told is None or (told.behind and _cued(text, a + told.behind)):
            return None  # no name, or its particle is a cue's preposition
        cue = (in_list and (told.given or not told.bad)) or form in ("titled", "small") or _cued(text, a) or SIGNATURE_BEFORE.search(text[max(0, a - 12) : a]) is not None
        behind = text[b : b + 60]
        after = NAME_AFTER.match(behind) is not None
        if after and not (told.given or told.family) and behind.lstrip(" \t").startswith(("\n", "\r")):
            after = False
        org = form != "small" and (told.organisation or ORGANISATION_AFTER.match(behind) or CAPTION.search(text[max(0, a - 25) : a]))
        votes = (
            1 if cue else -1, 1 if after else -1, 1 if told.given else -1, 1 if told.family else -1, 0 if org else -1, 0 if told.bad else -1,
        )
        return Candidate("person_name", a, b, votes, list(told.features))


# Names in small letters are looked for only where a person names themself.
_SMALL_PLACES = re.compile(
    rf"(?:(?:\bthis\s+is|\bmy\s+name\s+is)\s+|(?:^|\n)--[^\S\n]*\r?\n)({SMALL_NAME})(?=\s*[,|])", re.I
)
