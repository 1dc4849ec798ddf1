"""Personal information inside free text: found, typed, and replaced by placeholders.

Regular expressions propose spans. Checksum validators (Luhn, mod 97, mod 23, mod 11) confirm them, and veto those that no
word nearby names. Words nearby raise or lower the score, and spans that reach the threshold are replaced; where spans
overlap, the kinds take turns in the order of KINDS.

Names are judged by their shape, by the words before and behind them, and by how ordinary their words are: a word that
the vocabulary of a public tokenizer holds in lower case, or that the same text writes so, is an ordinary word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vocabulary import TOKENIZERS, ordinary_words

KINDS = ("email", "card_number", "id_number", "phone", "address", "name")
PLACEHOLDER = "[{}]"
THRESHOLD = 0.5

# Frequent given names of many languages; words that are no part of a name; particles of surnames.
GIVEN = frozenset(
    """aaron abdul abdullah adam ahmed aisha akira alan albert alejandro alessandro alexander alice ali amir amit amy ana anders andrea andrew angela anil anita anja anna antonio arthur ayse
    barbara ben bernard bernd bruno carl carlos carmen carol catherine charles charlotte chen chloe christian christine claire claudia daniel david deepak diana diego dieter dmitri dorothy
    edward elena elizabeth emily emma eric erik eva fatima felix fernando francesca francois frank gabriel george giovanni giulia gustav hamza hannah hans hassan helen henry hiroshi hugo ian
    ibrahim igor ines ingrid irina isabel ivan jack jacob james jan jane javier jean jennifer jessica johannes john jonas jorge jose josef joseph juan julia julien jurgen karen karl katherine
    kenji kevin khalid klaus krzysztof kwame lars laura lena leo linda lisa louis lucas lucia luis lukas manuel marco marek margaret maria marie mario mark markus marta martin mary mateo
    matthew mehmet michael miguel mohammed monika mustafa natalia nicolas nina olga oliver omar pablo patricia paul pavel pedro peter philip pierre piotr priya rachel rahul ravi ricardo
    richard robert rosa samuel sandra sara sarah sergei silvia simon sofia stefan stephen steven susan takashi thomas tomasz ursula victor vladimir walter wei werner william yuki yusuf zhang""".split()
)
_NOT_NAMES = frozenset(
    """the a an our one my this that these those any some all each every no not and or of in on at to for from with by as is are was were it he she they we you i who what when where why how if
    but so than then there here last first second next old other another same both most many few if after before since while until nothing only
    user users team crew desk group engineer reporter reviewer release build search docs platform night service error ticket version page file files set note notes list log job step steps row
    run table line lines name names author contact cc re fwd fw ask ring call thank thanks met see dear hello hi hey cheers regards best yours sincerely greetings please sorry sent
    der die das den dem des ein eine einer einem einen wir ihr sie er es ich am im in zum zur vom von mit nach aus auf für bei und oder nicht kein keine wie warum wann wo wer was wenn weil dass aber danke hallo liebe lieber gruß grüße rückruf
    le la les un une des nous vous ils elles il elle on je tu ce cette ces au aux du de dans en pour par sur avec sans et ou ne merci bonjour cordialement
    el los las una unos unas nosotros ellos usted yo esto esta este según para con sin sobre desde hasta cuando y o no se su gracias hola saludos
    mr mrs ms miss dr prof mme mlle madame monsieur frau herr herrn señor señora señorita sr sra srta dra sir inc ltd co corp gmbh llc""".split()
)
_PARTICLES = "van|von|der|den|de|del|della|di|da|dos|das|du|la|le|bin|ibn|al|el|ter|ten|zu|zur"


def _ranges(test) -> str:
    """The letters of the alphabets with case (Latin, Greek, Cyrillic) that pass the test, as ranges of a character class."""
    codes = [c for c in (*range(0x41, 0x530), *range(0x1E00, 0x2000)) if test(chr(c))]
    out, first = [], 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            a, b = chr(codes[first]), chr(codes[i - 1])
            out.append(a if a == b else f"{a}-{b}")
            first = i
    return "".join(out)


_U, _L = _ranges(str.isupper), _ranges(str.islower) + "\u0300-\u036f"
_TOK = rf"(?:(?:Mc|Mac|O[’']|D[’'])(?=[{_U}]))?[{_U}][{_L}’']+(?:-[{_U}][{_L}’']+)*"
_ANY = r"[^\W\d_][^\W\d_’']+(?:-[^\W\d_]+)*"

def _digits(s: str) -> list[int]:
    return [int(c) for c in s if c.isdecimal()]


def luhn(number: str) -> bool:
    d = _digits(number)[::-1]
    return bool(d) and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = re.sub(r"\W", "", iban).upper()
    return len(s) > 4 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def mod97_key(number: str) -> bool:
    """The last two digits are 97 less the rest modulo 97."""
    d = "".join(map(str, _digits(number)))
    return len(d) > 2 and 97 - int(d[:-2]) % 97 == int(d[-2:])


def mod23(dni: str) -> bool:
    s = re.sub(r"\W", "", dni).upper()
    number = {"X": "0", "Y": "1", "Z": "2"}.get(s[0], s[0]) + s[1:-1]
    return number.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(number) % 23] == s[-1]


def mod11(number: str) -> bool:
    """Two check digits of weighted sums modulo 11 (eleven digits, not all equal)."""
    d = _digits(number)
    check = lambda n: sum(x * w for x, w in zip(d, range(n + 1, 1, -1))) * 10 % 11 % 10
    return len(d) == 11 and len(set(d)) > 1 and check(9) == d[9] and check(10) == d[10]


_EMAIL = [
    re.compile(r"(?<![\w.+/-])[\w][\w.+-]*[ ]?@[ ]?(?:[a-z0-9-]+\.)+[a-z]{2,}(?![\w-])(?!:[\w/~])(?!/)", re.I),
    re.compile(r"(?<![\w.+/-])[\w][\w.+-]*\s?(?:\[at\]|\(at\)|\{at\}|<at>|\s@\s)\s?[a-z0-9-]+(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\.)\s?[a-z0-9-]+)*(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|<dot>)\s?|\.)[a-z]{2,}(?!\w)", re.I),
    re.compile(r"(?<![\w.+/-])[\w][\w.+-]* at [a-z0-9-]+(?: dot [a-z0-9-]+)* dot [a-z]{2,}(?!\w)", re.I),
]
_REMOTE = re.compile(r"(?:\b(?:ssh|scp|rsync|clone|remote|push|pull|fetch|npm|yarn|pip|add|install)\s+(?:-\S+\s+)*|://)$", re.I)
_FILE_ENDS = frozenset("py rs go ts js cs java md yaml yml toml json txt sh rb cpp hpp html css git lock".split())

_IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\w-])", re.I)
_SSN = re.compile(r"(?<![\w.:/-])\d{3}([- ])\d{2}\1\d{4}(?![\w/-]|\.\d)")
_NINO = re.compile(r"(?<![\w-])[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D](?![\w-])", re.I)
_DNI = re.compile(r"(?<![\w.-])(?:[XYZ]-?\d{7}|\d{8})-?[A-Z](?![\w-])", re.I)
_CARD = re.compile(r"(?<![\w-])[A-Z]{1,2}[ ]?\d{6,8}(?![\w-])", re.I)
_TAX = re.compile(r"(?<![\w.-])(?:\d{2}[ ./-]?\d{3}[ ./-]?\d{3}[ ./-]?\d{3}|\d{2}-\d{7}|\d{3}[ -]\d{3}[ -]\d{3}|\d{9,11})(?![\w-]|\.\d)")
_PAYMENT = re.compile(r"(?<![\w.+-])(?:4\d{3}|5[1-5]\d\d|2[2-7]\d\d|6011|65\d\d|35\d\d)([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-]|\.\d)|(?<![\w.+-])3[47]\d\d([ -]?)\d{6}\2\d{5}(?![\w-]|\.\d)")
#: Numbers in the notation of one register: without a word that names them the check digits decide. French insurance
#: number, Brazilian register of persons, Canadian insurance number.
_CHECKED = [
    (mod97_key, re.compile(r"(?<![\w.-])[12][ ]?\d\d[ ]?(?:0[1-9]|1[0-2])[ ]?\d{2}[ ]?\d{3}[ ]?\d{3}[ ]?\d{2}(?![\w-]|\.\d)")),
    (mod11, re.compile(r"(?<![\w.-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-]|\.\d)")),
]
_ID_WORDS = re.compile(
    r"(?:passport|passeport|reisepass|pasaporte|passnummer|personalausweis|ausweis|identity card|id card|carte d.identité|documento|cédula|social[- ]security|ssn|s\.s\.n|\bni\b|nino|national insurance|"
    r"national id|insurance n|tax|tin|itin|steuer|steuer-?id|nif|nie|dni|cpf|nir|aadhaar|pesel|bsn|codice fiscale|\bsin\b|iban|bank account|konto)(?:[ \t]*(?:card|number|nummer|id|no|nr|núm|num)\b\.?)*[ \t]*[:#=]?[ \t]*(?:is|was|ist|es)?[ \t]*$",
    re.I,
)
_BAD_WORDS = re.compile(r"(?:error|ticket|build|run|run id|port|line|row|rows|page|version|commit|revision|issue|code|chunk|offset|items?|order|invoice|batch|job|hash|sha|pin|host|release|seed)(?:[ \t]*(?:id|no|number|#|no\.))?[ \t]*[:#=]?[ \t]*$", re.I)

_PHONES = [
    (0.9, re.compile(r"(?<![\w.])\+\d{1,3}(?:[ .-]?\(0?\d{0,4}\))?(?:[ ./-]?\d{1,5}){2,6}(?:[ ]?(?:ext|x|ext\.|durchwahl)\.?[ ]?\d{1,5})?(?![\w-]|\.\d)")),
    (0.8, re.compile(r"(?<![\w./-])(?:1[ .-])?\([2-9]\d{2}\)[ .-]?\d{3}[ .-]?\d{4}(?:[ ,]*(?:ext|x)\.?[ ]?\d{1,5})?(?![\w-])")),
    (0.8, re.compile(r"(?<![\w./-])(?:1[ .-])?[2-9]\d{2}([ .-])[2-9]\d{2}\1\d{4}(?:[ ,]*(?:ext|x)\.?[ ]?\d{1,5})?(?![\w-]|\.\d)")),
    (0.8, re.compile(r"(?<![\w./-])\d{3}[-. ]\d{4}[ ,]*(?:ext|extension|x)\.?[ \n]?\d{1,5}(?!\w)", re.I)),
    (0.3, re.compile(r"(?<![\w./-])[2-9]\d{2}-\d{4}(?![\w-])")),
    (0.7, re.compile(r"(?<![\w./-])0\d{2,4}[ ]?/[ ]?\d{3,8}(?:[- ]\d{1,5})?(?![\w/-])")),
    (0.6, re.compile(r"(?<![\w./-])0(?:\d{4}[ ]\d{3}[ ]?\d{3}|\d([ .])\d{2}\1\d{2}\1\d{2}\1\d{2}|\d{3}[ ]\d{3}[ ]\d{4}|[1-9]\d{8,9})(?![\w-])")),
    (0.6, re.compile(r"(?<![\w./:-])1[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d)")),
    (0.3, re.compile(r"(?<![\w./:-])[2-9]\d{2}[2-9]\d{6}(?![\w-]|\.\d)")),
]
_PHONE_WORDS = re.compile(r"(?:tel|tél|phone|telephone|telefon|teléfono|téléphone|mobile|mobil|cell|handy|fax|call|ring|reach me|reach|rückruf|unter|desk is|i am on|on|dial|sms|whatsapp|hotline|pager|at)\b\.?[ \t]*(?:is|:|no\.?|unter)?[ \t]*$", re.I)

_CITY = r"(?-i:[A-ZÀ-Þ][\wß-ÿ’'-]+(?:[ ][A-ZÀ-Þ][\wß-ÿ’'-]+)?)"
_TAIL = rf"(?:[ ]*,?[ ]*(?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|piso)\.?[ ]*\w{{1,5}}|[ ]*,[ ]*\d{{1,2}}\.?[º°ª][ ]?(?:[A-Z](?!\w))?)?(?:[ ]*[,\n]\s*(?:\d{{4,5}}[ ]{_CITY}|{_CITY}(?:,?[ ](?:[A-Z]{{2}}[ ])?\d{{4,5}}(?:-\d{{4}})?|[ ][A-Z]{{1,2}}\d{{1,2}}[A-Z]?[ ]\d[A-Z]{{2}})?))?"
_STRONG = r"(?:Street|St\.|Road|Rd\.?|Avenue|Ave\.?|Drive|Lane|Ln\.?|Boulevard|Blvd\.?|Crescent|Parkway|Pkwy\.?|Highway|Hwy\.?)"
_WEAK = r"(?:St|Dr\.?|Court|Ct\.?|Way|Place|Pl\.?|Square|Sq\.?|Terrace|Close|Row|Hill|Gardens|Mews|Walk)"
_ADDRESSES = [
    re.compile(rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?(?:[ ]?-[ ]?\d+)?[ ](?:(?:[NSEW]\.?|North|South|East|West)[ ])?(?:[A-ZÀ-Þ][\w’'-]+[ ]){{1,3}}(?:{_STRONG}|{_WEAK})(?![\w-]){_TAIL}"),
    re.compile(rf"(?<![\w.-])\d{{1,5}}[a-z]?[ ](?:[\w’'-]+[ ]){{1,3}}{_STRONG}(?![\w-])[ ]*,[ ]*(?:apt\.?[ ]*\d+[ ]*[,\n][ ]*)?[\w’'-]+(?:[ ][\w’'-]+)?[ ]\d{{4,5}}\b", re.I),
    re.compile(rf"(?<![\w.-])(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig|pfad)|(?:[A-ZÄÖÜ][\wäöüß-]+[ -])(?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer))[ ]\d{{1,4}}(?:[ ]?[a-z](?!\w))?{_TAIL}"),
    re.compile(r"(?:straße|strasse|str\.|weg|gasse|allee|platz)[ ]\d{1,4}[a-z]?[ ]*,[ ]*\d{5}[ ]\w+", re.I),  # begins where its word does
    re.compile(rf"(?<![\w.-])\d{{1,4}}(?:[ ]?(?:bis|ter))?,?[ ](?:rue|avenue|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|square)[ ](?:(?:de[ ]la|des|du|de|de[ ]l[’']|d[’']|la|le|les)[ ]?)?[^\W\d_][\w’'-]+(?:[ ][A-ZÀ-Þ][\w’'-]+){{0,3}}{_TAIL}", re.I),
    re.compile(rf"(?<![\w.-])(?:Calle|C/|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carrera|Ronda)[ ]?(?:(?:de[ ]la|de[ ]los|de[ ]las|del|de)[ ])?[^\W\d_][\w’'-]+(?:[ ](?:de[ ]|del[ ]|la[ ])?[^\W\d_][\w’'-]+){{0,3}}?,?[ ](?:n\.?º[ ]?)?\d{{1,4}}(?:[ ]?(?:bis|[A-Za-z])(?!\w))?{_TAIL}", re.I),
    re.compile(rf"(?<![\w.-])(?:Via|Viale|Piazza|Corso|Vicolo|Rua|Avenida|Largo|ul\.|ulica|aleja)[ ](?:(?:dei|delle|della|del|di|da|do|dos)[ ])?(?-i:{_TOK})(?:[ ](?-i:{_TOK})){{0,2}},?[ ]\d{{1,4}}[a-z]?(?!\w){_TAIL}", re.I),
    re.compile(rf"(?<![\w.-])(?-i:[{_U}])[{_L}]+(?:straat|laan|plein|gracht|kade|gatan|vägen|gade|vej|katu)[ ]\d{{1,4}}[a-z]?(?!\w){_TAIL}", re.I),
    re.compile(rf"(?<!\w)(?:P\.?[ ]?O\.?[ ]?Box|Post[ ]Office[ ]Box|Postfach|Apartado(?:[ ]de[ ]correos)?|Bo[iî]te[ ]postale|Casilla|Postbus|(?-i:B\.?P\.))[ ]?(?:n[.º°]*[ ]?)?\d{{1,6}}(?:[ ]\d{{2,3}})*{_TAIL}", re.I),
]

# Behind trailers and titles stands a person, whatever the words.
_TRAILERS = tuple(f"{x}-by:" for x in "signed-off co-authored reviewed reported acked tested suggested helped approved".split())
_TITLES = "frau herr herrn mme mlle madame monsieur m. señora señor señorita sr. sra. sra srta. dra. don doña mrs mrs. mr mr. ms ms. miss prof. professor dr. mx mx.".split()
#: Words that people stand behind: reports, greetings, farewells, acts of speaking, in several languages.
_LIKELY = (
    "reported by|found by|written by|fixed by|made by|discovered by|reviewed by|noticed by|suggested by|sent by|filed by|according to|thanks|thanks to|thank you|thx|kudos|kudos to|credit to|"
    "credit goes to|hat tip to|props to|spoke to|spoke with|spoken to|speak to|speak with|talked to|talked with|talk to|talk with|wrote to|write to|listened to|reach out to|reached out to|met|met with|"
    "ask|asked|ring|call|phone|ping|email|mail|cc|attn|dear|hello|hi|hey|contact|colleague|regards|kind regards|best regards|cheers|best|yours|sincerely|"
    "gemeldet von|gefunden von|geschrieben von|danke|danke an|laut|hallo|grüße|grüßen|gruß|signalé par|trouvé par|écrit par|merci à|selon|bonjour|cordialement|"
    "reportado por|encontrado por|escrito por|gracias a|según|hola|saludos|segnalato da|grazie a|ciao|сообщил|сообщила|спасибо|привет|с уважением|\n--\n|\n-- \n"
).split("|")
_GAP = re.compile(r"[,:]?[ \t]*\n?[ \t]*")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in _LIKELY:
        a.add_word(w, (0.35, len(w)))
    for w in (*_TITLES, *_TRAILERS):
        a.add_word(w, (0.7, len(w)))
    a.make_automaton()
    return a


#: A label or a delimiter of a record.
_LABEL = re.compile(r"(?:\w:|[;|,])[ \t]+$|\t$")
#: What persons do, or how they can be reached: a personal pronoun, an affiliation, a verb, contact data that was found.
_AFTER = re.compile(
    r"[ \t]*(?:,[ ]who\b|,?[ ]from[ ](?:the[ ])?\w|,?[ ]of[ ]the[ ]\w+[ ](?:team|group|crew|department)\b|(?:can|could|may|will)[ ]be[ ](?:reached|contacted)\b|"
    r"(?:has[ ]|have[ ]|also[ ]|first[ ])?(?:said|says|wrote|writes|told|tells|asked|asks|called|phoned|reports|reported|confirms|confirmed|mentioned|noticed|suggested|suggests|sees|saw|thinks|replied|agrees|agreed)\b|"
    r"(?:sagt|sagte|schrieb|schreibt|meldet|meldete|bestätigt|fragt|fragte|hat)\b|(?:dit|écrit|confirme|signale|demande|a)\b|(?:dice|dijo|escribió|confirma|informó|pregunta)\b)",
    re.I,
)
#: Contact data: what was found before, or what looks like it.
_DATA = re.compile(r"[ \t]*(?:(?:,|on|at|under|unter|au|al|:|-|–|\(|<)?[ \t]*[<(]?\x00|(?:on|at)[ ](?:\+|\(|\d{3})|<[^<>\s]+@|\n[ \t]*(?:\x00|--))", re.I)
_FIELD = re.compile(r"[ \t]*[;|\t]")
#: A capitalised word or an initial; what may stand between those of one name; what may not stand behind one.
_CAPITAL = re.compile(rf"(?<![\w@.-])(?:({_TOK})|([{_U}]\.(?:[{_U}]\.)*))")
_BETWEEN = re.compile(rf"[ \n](?:(?:{_PARTICLES})[ ]){{0,2}}|[ ]?")
_NOT_BEHIND = re.compile(r"[\w@-]|\.\w")
_SURNAME = re.compile(rf"{_TOK}(?![\w@-]|\.\w)")
#: The same in small letters, which only words around can show.
_SMALL = re.compile(rf"(?P<given>{_ANY})(?:[ ][^\W\d_]\.)?[ ](?P<sur>{_ANY})(?![\w@-]|\.\w)|(?P<sur2>{_ANY}),[ ](?P<given2>{_ANY})(?:[ ][^\W\d_]\.)?(?![\w@-]|\.\w)|[^\W\d_]\.[ ](?P<sur3>{_ANY})(?![\w@-]|\.\w)")
#: Names in Chinese characters or kana before a form of address, but for words of roles and pronouns.
_EASTERN = re.compile(r"(?<![一-鿿])(?![一-鿿]{0,3}[者員员人官長长師师客皆誰谁])(?P<sur>[一-鿿]{1,3}|[ァ-ヺー]{2,8})(?=さん|様|先生|女士|小姐|氏(?![一-鿿]))")
_BEHIND_SMALL = (", who ", " from ", " can be ", " could be ", " hat ", " confirme ", " confirma ", " wrote ", " said ", " reported ", " called ", "\x00", ";")


def folded(s: str) -> str:
    s = s.lower().replace("ø", "o").replace("æ", "ae").replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


# What a text must have for a finder to be worth running.
_DIGITS = {n: re.compile(r"\d(?:[ ./()\n-]{0,3}\d){%d,}" % (n - 1)) for n in (6, 7, 13)}


def _areas(text: str, least: int, margin: int) -> list[tuple[int, int]]:
    """Where so many digits stand close together, with a margin; the rest of the text need not be searched for numbers."""
    out: list[tuple[int, int]] = []
    for m in _DIGITS[least].finditer(text):
        a, b = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _near(text: str, pattern: re.Pattern, areas: list[tuple[int, int]]) -> Iterator[re.Match]:
    for a, b in areas:
        yield from pattern.finditer(text, a, b)


_ADDRESS_WORDS = [
    tuple(" " + x.lower() for x in "Street St Road Rd Avenue Ave Drive Dr Lane Ln Boulevard Blvd Crescent Parkway Pkwy Highway Hwy Court Ct Way Place Pl Square Sq Terrace Close Row Hill Gardens Mews Walk".split()),
    (" street", " st.", " road", " rd", " ave", " drive", " lane", " ln", " boulevard", " blvd", " crescent", " parkway", " pkwy", " highway", " hwy"),
    ("straße", "strasse", "str.", "weg ", "gasse", "allee", "platz", "ring ", "damm", "ufer", "steig", "pfad"),
    ("straße", "strasse", "str.", "weg ", "gasse", "allee", "platz"),
    ("rue", "avenue", "boulevard", "bd", "place", "chemin", "impasse", "allée", "quai", "route", "cours", "square"),
    ("calle", "c/", "avenida", "avda", "av.", "plaza", "paseo", "camino", "carrera", "ronda"),
    ("via ", "viale", "piazza", "corso", "vicolo", "rua ", "avenida", "largo", "ul.", "ulica", "aleja"),
    ("straat", "laan", "plein", "gracht", "kade", "gatan", "vägen", "gade", "vej", "katu"),
    ("box", "postfach", "apartado", "postale", "casilla", "postbus", "b.p", "bp"),
]


#: Strings one of which a text must have for each of the patterns of addresses.
_EMAIL_SIGNS = (("@",), ("[at]", "(at)", "{at}", "<at>", " @ "), (" dot ",))


def _emails(text: str):
    low = text.lower()
    for signs, p in zip(_EMAIL_SIGNS, _EMAIL):
        if not any(x in low for x in signs):
            continue
        for m in p.finditer(text):
            s = m.group(0)
            host = re.split(r"@|\bat\b", s)[-1]
            end = re.split(r"[.\s\[\](){}<>]+", host.strip("[](){}<> "))[-1].lower()
            score = 0.9
            if end in _FILE_ENDS or _REMOTE.search(text[max(0, m.start() - 24) : m.start()]):
                score = 0.2
            yield m.start(), m.end(), score


def _cards(text: str):
    """Payment cards: digits in the usual groups whose first ones are of an issuer; Luhn decides, whatever stands nearby."""
    for m in _near(text, _PAYMENT, _areas(text, 13, 4)):
        yield m.start(), m.end(), 0.9 if luhn(m.group(0)) and len(set(_digits(m.group(0)))) > 1 else 0.0


def _ids(text: str):
    def around(m: re.Match) -> tuple[bool, bool]:
        before = text[max(0, m.start() - 40) : m.start()]
        return bool(_ID_WORDS.search(before)), bool(_BAD_WORDS.search(before))

    areas = _areas(text, 6, 40)
    for m in _near(text, _IBAN, areas):
        good, bad = around(m)
        yield m.start(), m.end(), 0.95 if good or mod97(m.group(0)) else 0.2
    for m in _near(text, _SSN, areas):
        good, bad = around(m)
        yield m.start(), m.end(), 0.95 if good else 0.2 if bad else 0.7
    for m in _near(text, _NINO, areas):
        good, bad = around(m)
        yield m.start(), m.end(), 0.95 if good else 0.2 if bad else 0.7 if m.group(0)[:2].isupper() else 0.3
    for m in _near(text, _DNI, areas):
        good, bad = around(m)
        yield m.start(), m.end(), 0.95 if good else 0.2 if bad else 0.7 if mod23(m.group(0)) else 0.5 if "-" in m.group(0) else 0.3
    for m in _near(text, _CARD, areas):
        good, bad = around(m)
        yield m.start(), m.end(), 0.9 if good else 0.2
    for m in _near(text, _TAX, areas):
        good, bad = around(m)
        yield m.start(), m.end(), 0.9 if good else 0.2
    for valid, p in _CHECKED:
        for m in _near(text, p, areas):
            good, bad = around(m)
            yield m.start(), m.end(), 0.95 if good else 0.7 if valid(m.group(0)) and not bad else 0.2


def _phones(text: str):
    areas = _areas(text, 7, 24)
    for base, p in _PHONES:
        for m in _near(text, p, areas):
            before = text[max(0, m.start() - 24) : m.start()]
            digits = sum(c.isdigit() for c in m.group(0))
            score = base
            if digits < 7 or digits > 17:
                score = 0.0
            if _PHONE_WORDS.search(before):
                score += 0.3
            elif _BAD_WORDS.search(before):
                score -= 0.6
            if before.endswith("\n") or before.endswith("; "):
                score += 0.1
            yield m.start(), m.end(), score


@lru_cache(maxsize=1)
def _address_words():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in {w for words in _ADDRESS_WORDS for w in words}:
        a.add_word(w, ({i for i, words in enumerate(_ADDRESS_WORDS) if w in words}, len(w)))
    a.make_automaton()
    return a


def _addresses(text: str):
    low, worth = text.lower(), set()
    for end, (which, size) in _address_words().iter(low):
        if which != {0} or text[end - size + 2 : end - size + 3].isupper() or len(low) != len(text):  # the words of the first pattern begin with a capital
            worth |= which
    for p in (_ADDRESSES[i] for i in sorted(worth)):
        for m in p.finditer(text):
            s = m.start()
            while p is _ADDRESSES[3] and s and (text[s - 1].isalnum() or text[s - 1] in "_-"):
                s -= 1
            yield s, m.end(), 0.8


_ENDINGS = ("s", "es", "ed", "ing", "er", "ers", "en")
_SMALL_WORDS = re.compile(rf"(?<![\w@.-])[{_L}]{{3,}}(?![\w@-])")


def _ordinary(word: str, known: frozenset[str], small: set[str]) -> bool:
    """Whether the word, or each part of one with hyphens, is an ordinary one; small holds the text's own words."""
    if "-" in word:
        return all(_ordinary(x, known, small) for x in word.split("-") if x)
    w = word.lower()
    if w in _NOT_NAMES or w in known or any(len(w) > 3 + len(x) and w.endswith(x) and w[: -len(x)] in known for x in _ENDINGS):
        return True
    return w != word and w in small


class _Around:
    """How much what stands around a place of the text speaks for a person there."""

    def __init__(self, text: str) -> None:
        self.text = text
        low = text.lower()
        low = low if len(low) == len(text) else text
        #: Where a person may begin, behind cues, and how much that says.
        self.places: dict[int, float] = {4: 0.35} if low.startswith("-- \n") else {}
        for end, (much, size) in _automaton().iter(low):
            start, at = end - size + 1, end + 1
            if low[start].isalpha() and start and (low[start - 1].isalnum() or low[start - 1] in "_@./-" and much < 0.7) or low[end].isalpha() and at < len(low) and (low[at].isalnum() or low[at] in "_-"):
                continue
            if much == 0.7 and low[end] != ":":
                if text[at : at + 1] not in (" ", "\xa0") or low[start : at] == "m." and text[start] != "M":
                    continue
                at += 1
            elif low[end] != "\n":
                at = _GAP.match(text, at).end()
            self.places[at] = max(much, self.places.get(at, 0.0))
        self._small: set[str] | None = None

    @property
    def small(self) -> set[str]:
        if self._small is None:
            self._small = set(_SMALL_WORDS.findall(self.text))
        return self._small

    def score(self, s: int, e: int) -> tuple[float, float]:
        """Words before, words behind."""
        behind = 0.35 if _DATA.match(self.text, e) else 0.25 if _AFTER.match(self.text, e) else 0.0
        before = self.places.get(s, 0.0)
        if not before and _LABEL.search(self.text[max(0, s - 8) : s]):
            return 0.2, behind or 0.2 * bool(_FIELD.match(self.text, e))
        return before, behind


@lru_cache(maxsize=1 << 16)
def _given(word: str) -> bool:
    w = word.lower() if word.isascii() else folded(word)
    return w in GIVEN or "-" in w and w.split("-")[0] in GIVEN


def _judged(parts: list[str], around: _Around, before: float, behind: float, known: frozenset[str], small: bool = False) -> float:
    given = any(_given(p) for p in parts)
    if not given and not before and not behind:
        return 0.35  # at most
    odd = not any(_ordinary(p, known, set() if small else around.small) for p in parts if len(p) > 2)
    return round(0.1 + (0.5 if given else 0.25 if odd else -0.2) + before + behind - 0.15 * small, 2)


def _in_run(text: str, run: list, ends: list[bool], blocked: list[bool], around: _Around, known: frozenset[str], taken: list):
    """The names in a run of capitalised words and initials. Words of the sentence around, titles and greetings are cut
    off at both ends; so is what stands before a cue."""
    first = next((i for i in range(len(run) - 1, 0, -1) if run[i][0] in around.places and len(run) - i > 1), 0)
    while first < len(run) and blocked[first]:
        first += 1
    last = next((i for i in range(first, len(run)) if blocked[i] and (i < first + 2 or run[i][1] - run[i][0] > 2)), len(run))
    for i in range(first + 1, last):  # a line ends within a name only between its first words, and not if the line began with it
        if "\n" in text[run[i - 1][1] : run[i][0]] and (i > first + 1 or run[first][0] == 0 or text[run[first][0] - 1] == "\n"):
            last = i
            break
    while last > first and (run[last - 1][2] or not ends[last - 1]):
        last -= 1
    name = run[first:last]
    parts = [text[a:b] for a, b, initial in name if not initial]
    if not parts or len(parts) > 5:
        return
    s, e = name[0][0], name[-1][1]
    before, behind = around.score(s, e)
    score = _judged(parts, around, before, behind, known)
    if len(parts) == 1:  # one word less to judge by, and an initial before it
        if name[0][2]:
            yield s, e, score - (0.25 if before + behind == 0 else 0)
        return
    if score >= THRESHOLD:
        taken.append((s, e))
    yield s, e, score


def _people(text: str, known: frozenset[str]):
    around = _Around(text)
    taken: list[tuple[int, int]] = []
    tokens = [(*m.span(), m.lastindex == 2) for m in _CAPITAL.finditer(text)]
    # those near others; the rest can be no name
    near = [b[0] - a[1] <= 16 for a, b in zip(tokens, tokens[1:])]
    tokens = [t for t, x, y in zip(tokens, [False, *near], [*near, False]) if x or y]
    # a place where a word may end a name: nothing of an identifier, address or host follows
    ends = [not _NOT_BEHIND.match(text, e) for _, e, _ in tokens]
    word = lambda t: text[t[0] : t[1]]
    blocked = [not t[2] and word(t).lower() in _NOT_NAMES for t in tokens]
    n, i = len(tokens), 0
    while i < n:
        j = i
        while j + 1 < n and tokens[j + 1][0] - tokens[j][1] <= 16 and _BETWEEN.fullmatch(text, tokens[j][1], tokens[j + 1][0]) and (tokens[j][2] or tokens[j + 1][0] > tokens[j][1]):
            j += 1
        run = tokens[i : j + 1]
        if j > i:
            yield from _in_run(text, run, ends[i : j + 1], blocked[i : j + 1], around, known, taken)
        # family name first: the last word of this run and the first of the next, with a comma between
        if j + 1 < n and text[tokens[j][1] : tokens[j + 1][0]] == ", " and not tokens[j][2] and not tokens[j + 1][2] and not blocked[j] and not blocked[j + 1]:
            k = j + 1
            if k + 1 < n and tokens[k + 1][2] and text[tokens[k][1] : tokens[k + 1][0]] == " ":
                k += 1
            if ends[k] or ends[j + 1]:
                s, e = tokens[j][0], tokens[k if ends[k] else j + 1][1]
                before, behind = around.score(s, e)
                cued = before >= 0.35 or behind
                yield s, e, _judged([word(tokens[j]), word(tokens[j + 1])], around, before, behind if cued else 0.0, known) - (0.0 if cued else 0.1)
        i = j + 1
    if any(x in text for x in ("さん", "様", "先生", "女士", "小姐", "氏")):
        for m in _EASTERN.finditer(text):
            yield m.start(), m.end(), 0.7
    for at, much in around.places.items():
        if much == 0.7 and text[at : at + 1].isupper() and text[at - 2] != ":" and (m := _SURNAME.match(text, at)) and m.group(0).lower() not in _NOT_NAMES:
            yield at, m.end(), 0.6
    # in small letters: behind a cue, or before one
    for at in sorted({*around.places, *_before(text, known)}):
        m = _FIRST.match(text, at)
        if m is None or (w := m.group(0).lower()) in _NOT_NAMES or w in known and w not in GIVEN or any(a <= at < b for a, b in taken):
            continue
        m = _SMALL.match(text, at)
        if m is None:
            continue
        parts = [x for x in m.groupdict().values() if x]
        if any(p.lower() in _NOT_NAMES or len(p) < 3 for p in parts) or all(p[:1].isupper() for p in parts) and "," not in m.group(0):
            continue
        before, behind = around.score(at, m.end())
        if at == 0 or text[at - 1] == "\n" or text[max(0, at - 2) : at] == ". ":  # the subject of a sentence
            before = max(before, 0.1)
        yield at, m.end(), _judged(parts, around, before, behind, known, True)


_FIRST = re.compile(_ANY + r"|[^\W\d_](?=\.)")


def _before(text: str, known: frozenset[str]) -> Iterator[int]:
    """Where the two words before contact data, a personal pronoun or a verb begin, unless the second is ordinary."""
    for sign in _BEHIND_SMALL:
        at = text.find(sign)
        while at > 0:
            end = len(text[:at].rstrip(" \n<(")) if sign == "\x00" else at
            a = max(0, end - 40)
            words = text[a:end].rsplit(" ", 3)
            w = words[-1].lower()
            if len(words) > 1 and w[:1].isalpha() and w not in known and w not in _NOT_NAMES or len(words) > 1 and words[-2][-1:] == ",":
                n = 3 if len(words) > 2 and len(words[-2]) == 2 and words[-2][1] == "." and words[-3][-1:].isalpha() else 2
                start = end - len(" ".join(words[-n:]))
                yield start + max(text[start:end].rfind(c) for c in "\n\t>") + 1
            at = text.find(sign, at + 1)


_FINDERS = {"email": _emails, "card_number": _cards, "id_number": _ids, "phone": _phones, "address": _addresses}
_HINT = re.compile(r"\d{3}|\d\d[ .]\d\d|@|\bat\b|[^\W\d_][^\W\d_]|[^\W\d_]\.", re.I)


def find_pii(text: str | None, threshold: float = THRESHOLD, tokenizers: str = TOKENIZERS) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, score) in code points, in order, without overlap."""
    if not text or not _HINT.search(text):
        return []
    spans: list[tuple[int, int, str, float]] = []
    work = text.replace("\r\n", " \n").replace("\xa0", " ")  # as long as the text
    for kind in KINDS:
        best: list[tuple[int, int, float]] = []
        proposed = _people(work, ordinary_words(tokenizers)) if kind == "name" else _FINDERS[kind](work)
        for s, e, score in sorted((x for x in proposed if x[2] >= threshold), key=lambda x: (x[0], -x[1])):
            if best and s < best[-1][1]:
                if e - s > best[-1][1] - best[-1][0] and s == best[-1][0]:
                    best[-1] = (s, e, score)
                continue
            best.append((s, e, score))
        for s, e, score in best:
            while e > s and work[e - 1] in " \n\t,;":
                e -= 1
            spans.append((s, e, kind, min(1.0, round(score, 2))))
            # what was found is out of sight of the later kinds; its first character shows that something was there
            work = work[:s] + "\x00" * (e - s) + work[e:]
    return sorted(spans)


def redact(text: str | None, spans: list[tuple[int, int, str, float]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s, e, kind, _ in spans:
        out += [text[at:s], PLACEHOLDER.format(kind.upper())]
        at = e
    return "".join([*out, text[at:]])


def _batches(batches: Iterator[pa.RecordBatch], threshold: float, with_text: bool, tokenizers: str) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pii_type", pa.string()), ("score", pa.float64())]))
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        spans = {t: find_pii(t, threshold, tokenizers) for t in set(texts)}  # repeated texts once
        found = [spans[t] for t in texts]
        made = [pa.array([[dict(zip(("start", "end", "pii_type", "score"), x)) for x in f] for f in found], span)]
        if with_text:
            made.append(pa.array([redact(t, f) for t, f in zip(texts, found)], pa.string()))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "spans", "redacted"][: b.num_columns - 1 + len(made)])


def redact_pii(bodies: DataFrame, text_col: str = "body", threshold: float = THRESHOLD, with_text: bool = True, tokenizers: str = TOKENIZERS) -> DataFrame:
    """bodies without text_col, with spans array<struct<start int, end int, pii_type string, score double>> (0-based
    code points, end exclusive, empty if none) and redacted: the text with [EMAIL], [CARD_NUMBER], [ID_NUMBER], [PHONE],
    [ADDRESS] or [NAME] in place of each span and everything else untouched.

    A null text has no spans and a null redacted; an empty one stays empty. Rows come out one for one, without a
    shuffle; columns of those names in the input are replaced.
    """
    others = [c for c in bodies.columns if c not in (text_col, "spans", "redacted")]
    df = bodies.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    kept += ", spans array<struct<start int, end int, pii_type string, score double>>" + (", redacted string" if with_text else "")
    return df.mapInArrow(lambda it: _batches(it, threshold, with_text, tokenizers), kept.removeprefix(", "))
