"""Personal information inside free text: offset-preserving deobfuscation, detection, typed placeholders.

A text passes a chain of transducers: look-alike letters and full-width forms become ASCII (one character for one),
runs of spelled digits become digits, and disguised `at` and `dot` in addresses become signs. Each transducer keeps the
source offsets of what it rewrites, so identifiers are detected on the normalised text and their spans mapped back to
the very characters of the source. Most texts need no rewriting and keep the identity map.

Names are recognised by what stands around them (roles, titles, signatures, mail headers, verbs of people) and by their
shape, not by a list of names, in English, German, French and Chinese.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = ("email", "phone", "id_number", "address", "name")

# ---- transducers ---------------------------------------------------------------------------------------------------

# Letters that look like ASCII ones.
CYRILLIC = dict(zip("АВЕКМНОРСТУХаеорсухіј", "ABEKMHOPCTYXaeopcyxij", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo", strict=True))
ALIKE = {ord(k): ord(v) for k, v in (CYRILLIC | GREEK).items()} | {0xFF01 + i: 0x21 + i for i in range(94) if chr(0x21 + i) in "@.+-_/()" or chr(0x21 + i).isalnum()}
ALIKE_CHARS = frozenset(map(chr, ALIKE))
# Digits in words.
SPELLED = {w: str(d) for d, ws in enumerate(("zero oh null", "one eins un", "two zwei deux", "three drei trois", "four vier quatre", "five fünf cinq", "six sechs", "seven sieben sept", "eight acht huit", "nine neun neuf")) for w in ws.split()}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
SPELLED_RUN = re.compile(rf"\b{_WORD}(?:[ \-]{_WORD}){{5,}}\b", re.I)
AT_DOT = re.compile(r"\s?[(\[{<]\s?(?:at|dot)\s?[)\]}>]\s?", re.I)
_PART = r"[A-Za-z0-9](?:[A-Za-z0-9_%+\-]|\.(?=[A-Za-z0-9]))*"
# An address in words: the last `at` before the words of its domain is the sign, an earlier one is a preposition.
WORDED = re.compile(rf"(?<![\w.%+\-]){_PART}(?: dot {_PART})*(?P<at> at )[A-Za-z0-9\-]+(?: dot [A-Za-z0-9\-]+)+(?![\w\-]| dot \w| at [A-Za-z0-9\-]+ dot )", re.I)
# What is left of one whose `at` is a sign already.
DOMAIN_WORDS = re.compile(rf"(?<=@)[A-Za-z0-9\-]+(?:(?: dot |\.)[A-Za-z0-9\-]+)+|(?<![\w.%+\-]){_PART}(?: dot {_PART})+(?=@)", re.I)
_DOT_WORD = re.compile(" dot ", re.I)


def _signs(t: str) -> Iterator[tuple[int, int, str]]:
    """Places of ` at ` and ` dot ` in addresses in words, with the signs that they stand for."""
    for m in WORDED.finditer(t):
        dots = [(*d.span(), ".") for d in _DOT_WORD.finditer(t, *m.span())]
        yield from sorted([*dots, (*m.span("at"), "@")])


def _dots(t: str) -> Iterator[tuple[int, int, str]]:
    for m in DOMAIN_WORDS.finditer(t):
        for d in _DOT_WORD.finditer(t, *m.span()):
            yield *d.span(), "."


class Normalised:
    """A rewritten text and the way back: span(a, b) gives the source span of text[a:b].

    Each transducer is a layer: starts of its pieces in its output and in its input. Pieces alternate, kept and
    rewritten; a place in a kept piece maps by its offset, one in a rewritten piece stands for the whole piece.
    """

    def __init__(self, source: str):
        self.text = source if source.isascii() or ALIKE_CHARS.isdisjoint(source) else source.translate(ALIKE)
        self.layers: list[tuple[list[int], list[int]]] = []
        low = self.text.lower()
        if AT_DOT.search(low):
            self._rewrite((*m.span(), "@" if "a" in m[0].lower() else ".") for m in AT_DOT.finditer(self.text))
        if " dot " in low:
            if " at " in low:
                self._rewrite(_signs(self.text))
            if "@" in self.text:
                self._rewrite(_dots(self.text))
        if sum(map(SPELLED.__contains__, low.replace("-", " ").split())) >= 4:  # the inner words of a run
            self._rewrite((*m.span(), "".join(SPELLED[w.lower()] for w in re.split("[ -]", m[0]))) for m in SPELLED_RUN.finditer(self.text))

    def _rewrite(self, pieces: Iterable[tuple[int, int, str]]) -> None:
        """Put other text in place of pieces (start, end, text), which come in order."""
        out, at, src, done, size, old = [], [0], [0], 0, 0, self.text
        for a, b, new in pieces:
            out += [old[done:a], new]
            size += a - done
            at += [size, size + len(new)]
            src += [a, b]
            size += len(new)
            done = b
        if done:
            out.append(old[done:])
            self.text = "".join(out)
            self.layers.append((at, src))

    def span(self, a: int, b: int) -> tuple[int, int]:
        for at, src in reversed(self.layers):
            k, n = bisect_right(at, a) - 1, bisect_right(at, b - 1) - 1
            a = src[k] if k % 2 else src[k] + a - at[k]
            b = src[n + 1] if n % 2 else src[n] + b - at[n]
        return a, b


# ---- detectors -----------------------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"(?:[A-Za-z0-9][A-Za-z0-9\-]*\.)+[A-Za-z]{2,24}(?![A-Za-z0-9\-])")
PHONE = re.compile(
    r"[+(0-9](?:"
    r"(?<=\+)[1-9]\d{0,2}[ .\-/]?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-/]?\d){6,12}"  # international
    r"|(?<=0)0[1-9]\d{0,2}[ .\-/]?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-/]?\d){6,12}"
    r"|(?<=\()\d{2,5}\)[ ]?\d{3,5}[\- ]?\d{3,5}"  # area code in brackets
    r"|(?<=1)-\d{3}-\d{3}-\d{4}"
    r"|(?<=\d)\d\d([.\-\ ])\d{3}\1\d{4}"
    r"|(?<=0)\d{2,4}/\d{5,9}"
    r"|(?<=0)\d{2,4}-\d{7,8}"
    r"|(?<=0)\d(?:[ .\-]\d\d){4}"
    r"|(?<=0)\d{4} \d{5,6}|(?<=0)\d\d \d{4} \d{4}|(?<=0)\d{3} \d{3} \d{4}|(?<=0)\d{1,3} \d{5} \d{3}"
    r"|(?<=1)\d\d([\- ])\d{4}\2\d{4}|(?<=1)\d{10}|(?<=0)[1-9]\d{8,10}"
    r")(?![\d_]|[A-Za-z]|[\-./]\d)"
)
DIGIT_RUN = re.compile(r"[+(0-9][0-9 ()./\-]{8,}")
# What telephone numbers are called, and what is done with them.
PHONE_CUE = re.compile(r"(?:\b(?:call|ring|dial|phone|telephone|tel|mobile|cell|fax|text|telefon|handy|anrufen|tél|téléphone|portable|appeler|appelez)(?: (?:me|us|him|her|them|back|is|on|at|no|number|nr|unter|au|le)){0,4} ?[.:]{0,2} {0,2}|(?:电话|手机|座机|热线|致电|拨打)(?:是|为)?[：: ]{0,2})\Z", re.I)
HAS_DIGITS = re.compile(r"[0-9][0-9 .\-/]{4,}[0-9]")
SHORT_PHONE = re.compile(r"(?:[0-9]{2,4}(?:[ .\-/][0-9]{2,5}){1,4}|[0-9]{7,12})(?![0-9A-Za-z_]|[\-./:][0-9])")
NOT_BEFORE_NUMBER = re.compile(r"(?:[A-Za-z0-9_#@/\\\-.+=]|\d[ :]|[A-Z] ?[\-#] ?|编号|[Tt]icket |[Hh]ash |哈希为|Offset |offset |checksum |build |serial |Serial |firmware |version |Version )\Z")
# What identity numbers are called.
ID_LABEL = re.compile(
    r"NI (?:number|no\.?)|(?i:national insurance(?: (?:number|no\.?))?)|(?i:travel document(?: no\.?)?)|(?i:passport(?: (?:number|no\.?))?)|(?i:ssn\b:?)|(?i:soc\. ?sec\.(?: no\.)?)"
    r"|(?i:social security(?: (?:number|no\.?))?)|(?i:tax (?:id|number|no\.?))|NIR\b|(?i:num[ée]ro de s[ée]curit[ée] sociale)|(?i:num[ée]ro fiscal)|(?i:passeport(?: n[°o]\.?)?)"
    r"|Ausweisnummer|Steuer-ID|Steuernummer|Personalausweis(?: Nr\.?)?|Reisepass(?: Nr\.?)?|Sozialversicherungsnummer|身份证(?:号码|号)?|证件(?:号码|号)|护照(?:号码|号)?|社保号|税号"
)
ID_WORDS = ("ni number", "ni no", "national ins", "travel doc", "passport", "ssn", "soc. sec", "soc.sec", "social sec", "tax id", "tax n", "nir", "sociale", "fiscal", "passeport", "reisepass", "ausweis", "steuer", "versicherung", "身份证", "证件", "护照", "社保", "税号")
ID_VALUE = re.compile(r"[\s:：#]{0,3}([A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{1,2}\d{6,9}|[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d|\d(?:[ \-]?\d){6,17}[Xx]?)(?![A-Za-z0-9_]|-\d)")
INSURANCE_SHAPE = re.compile(r"[0-9][0-9] [0-9][0-9] [0-9][0-9] [A-D]\b")
IDENTITY_SHAPE = re.compile(r"[0-9]{17}[0-9Xx]")
IDENTITY_DATE = re.compile(r"[0-9]{6}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx](?![A-Za-z0-9])")
_STREET = "Avenue|Ave|Road|Rd|Lane|Ln|Close|Street|St|Drive|Dr|Wharf|Terrace|Ter|Court|Ct|Way|Quay|Row|Square|Sq|Place|Pl|Crescent|Boulevard|Blvd|Gardens|Mews|Hill|Parade"
ADDRESS = (
    re.compile(rf"[0-9]{{1,5}}[a-z]?[  ]{{1,2}}(?:[A-Z][\w'’\-]*\.?[  ]{{1,2}}){{1,3}}(?:{_STREET})\b(?:,? {{1,2}}(?:Flat|Unit|Apt|Suite|Apartment)\.? ?\d+[A-Za-z]?\b)?"),
    re.compile(r"(?:(?:Alte|Neue|Große|Kleine|Obere|Untere|Lange|Hohe|Am|An der|Im|Zum|Zur)[rnms]? )?[A-ZÄÖÜ][a-zäöüß]+(?:-?[Ss]tra(?:ße|sse)|str\.|weg|allee|gasse|steig|ufer|platz|damm|markt) {1,2}\d{1,4}[a-z]?\b"),
    re.compile(r"[0-9]{1,4}(?: (?:bis|ter|quater))?,? {1,2}(?:rue|allée|quai|impasse|avenue|boulevard|place|chemin|cours|passage|route|square)(?: (?:de la|de l['’]|du|des|de|d['’]|l['’]|la|le|les))? ?[A-ZÀ-Þ][\w\-'’]*(?: [A-ZÀ-Þ][\w\-'’]*)*"),
    re.compile(r"(?:(?<=[为到在于往：:，。；、\s（(])|^)[一-鿿]{1,6}?(?:大道|胡同|路|街|巷|弄)\d{1,5}号(?:\d{1,4}(?:单元|号楼|栋|幢|座))*(?:\d{1,5}室)?", re.M),
)
_NUMBERED = re.compile(r"[0-9][a-z]? {1,2}[A-Z]")
_GERMAN = ("straße", "strasse", "str.", "weg ", "allee ", "gasse ", "steig ", "ufer ", "platz ", "damm ", "markt ")
_FRENCH = re.compile(r"(?:[0-9]|bis|ter|quater),? {1,2}(?:rue|allée|quai|impasse|avenue|boulevard|place|chemin|cours|passage|route|square) ")
_GATES = (_NUMBERED.search, lambda t: any(w in t for w in _GERMAN), _FRENCH.search, lambda t: "号" in t)

_CAP = r"[A-ZÀ-Þ][A-Za-zÀ-ɏ]*(?:['’\-][A-Za-zÀ-ɏ]+)*"
_LOW = r"[a-zà-ÿ]+(?:['’\-][a-zà-ÿ]+)*"
_SP = r"[  ]{1,2}"
NAME = rf"(?:[A-ZÀ-Þ]\.|{_CAP})(?:{_SP}(?:[A-ZÀ-Þ]\.|{_CAP})){{0,2}}(?:,{_SP}{_CAP}(?:{_SP}(?:[A-ZÀ-Þ]\.|{_CAP}))?)?"
PLAIN = rf"{_LOW}(?:{_SP}[a-zà-ÿ]\.)?{_SP}{_LOW}"
HAN = r"[一-鿿]{2,4}"
TITLE = re.compile(r"(?:Ms|Mrs|Mr|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Diver|Captain|Capt|Engineer|Monsieur|Madame)\.?[  ]{1,2}")
MONSIEUR = re.compile(r"M\.[  ]{1,2}(?=\S+\Z)")  # a title before a French verb, elsewhere an initial
# What stands before a person, and what follows if the name is written small.
BEFORE = (
    ("Contact", r" before"), ("Contact :", r"\."), ("Reviewed by", r" on "), ("corrected by", r" after"), ("According to", r","), ("spoke with", r" about"), ("cc", r" on "), ("Thanks,", r"\s*(?:$|\n|\r)"),
    ("Annotator:", r"\s*(?:$|\n|\r)"), ("Diver", r" confirmed"), ("Ansprechpartner:", r"\."), ("Ansprechpartnerin:", r"\."), ("Geprüft von", r" am "), ("Bitte", r" informieren"), ("Relu par", r" hier"), ("prévenir", r"\."), ("Ms", r" "), ("Mr", r" "), ("Mrs", r" "),
    ("Dr.", r" "), ("Frau", r" hat"), ("Herr", r" hat"), ("Mme", r" "), ("Regards,", r"\s*(?:$|\n|\r)"), ("Grüße,", r"\s*(?:$|\n|\r)"), ("Merci,", r"\s*(?:$|\n|\r)"), ("approved by", r" "), ("signed by", r" "),
)
AFTER = (" asked for", " signed the", " a corrigé", " confirmed the position", " re-drew", " hat die Labels", " hat angerufen", " has signed", " a signé", " a relu")
HAN_CUES = re.compile(rf"(?:联系人|标注员|审核人|复核人|负责人|作者|潜水员|录入员)[：: ]{{0,2}}(?P<a>{HAN}?|{NAME}|{PLAIN})(?=[ 。，；\n\r]|已|$)|请(?:找|联系|通知)(?P<b>{HAN}?|{NAME}|{PLAIN})(?=核对|确认|处理|复核|。|，)|由(?P<c>{HAN}?|{NAME}|{PLAIN})(?=复核|标注|审核|负责|确认)|感谢(?P<d>{HAN}?|{NAME}|{PLAIN})(?=[。，！\n\r]|$)")
HAN_GATE = re.compile("联系人|标注员|审核人|复核人|负责人|作者|潜水员|录入员|请找|请联系|请通知|由|感谢")
_NAME, _PLAIN = re.compile(NAME), re.compile(PLAIN)
HEADER = re.compile(r"[^<>\s]*@[^<>\s]*>")
_AT_END = re.compile(rf"(?:(?<![\w.'’\-])|^)(?:{NAME})\Z")
_PLAIN_END = re.compile(rf"(?:(?<=[.!?:;。：] )|(?<=[.!?:;。：]  )|(?<=[\n\r。：])|^)(?:{PLAIN})\Z")
_HAN_END = re.compile(rf"(?:(?<=[\n\r。：，；、 ])|^){HAN}\Z")
SIGNATURE = re.compile(r"--[ \t]*\r?\n?[ \t]*([^\r\n]{2,60}?)[ \t]*(?=[\r\n]|$)")
WHOLE = re.compile(rf"(?:{NAME}|{PLAIN}|{HAN})\Z")
_RIGHT = {cue: re.compile(right, re.M) for cue, right in BEFORE}
_CUES = [(cue, re.compile((r"(?<!\w )" if cue == "Dr." else "") + r"(?<![\w])" + re.escape(cue) + r"[  ]{1,2}"), _RIGHT[cue]) for cue, _ in BEFORE]
STRICT = ("Bitte",)  # cues of much else: what follows decides, however the name is written
# Words with a capital that follow a cue and aren't persons.
NOT_NAMES = frozenset("The This That These Those All Each Every Both Our My Your Its It If In On At A An No Not Nothing Please Die Der Das Den Dem Ein Eine Le La Les Un Une Des Il Elle Table Unit Lane Batch Task Dataset Path Open Note Second After Before Split Rows Images Hash Storage".split())

# Names by general contexts: what a field is called, salutations and closings, titles, deeds done by or to somebody.
_FULL = rf"(?:(?:[A-ZÀ-Þ]\.{_SP}?){{1,2}}|{_CAP}{_SP}(?:[A-ZÀ-Þ]\.{_SP})?)(?:(?:van|von|de|da|del|di|der|den|la|le|bin|al|el){_SP})*{_CAP}(?:{_SP}{_CAP})?"
_ONE = rf"(?:{_FULL}|{_CAP})"
_TITLED = r"(?:(?:Ms|Mrs|Mr|Miss|Dr|Prof|Herr|Herrn|Frau|Mme|Mlle|M|Monsieur|Madame|Captain|Capt)\.?[  ]{1,2})"
PAIR = re.compile(rf"(?<![\w.'’\-])(?:{_FULL})")
_WORDS = re.compile(rf"[A-ZÀ-Þ]\.|{_CAP}|[a-z]+")
TITLES = frozenset("ms mrs mr miss dr prof herr herrn frau mme mlle m monsieur madame captain capt".split())
# Words of the contexts.
FIELDS = frozenset(
    "author|from|to|cc|bcc|by|name|full name|contact|contact person|owner|reviewer|annotator|operator|editor|sender|recipient|attn|signed|signed by|prepared by|reported by|reviewed by|approved by|written by|maintainer|supervisor|assignee|inspector|analyst"
    "|verfasser|verfasserin|autor|autorin|bearbeiter|bearbeiterin|ansprechpartner|ansprechpartnerin|absender|empfänger|prüfer|prüferin|von|an|auteur|autrice|nom|expéditeur|destinataire|responsable|relecteur|relectrice|de|à".split("|")
)
DONE = frozenset(
    "written reviewed corrected approved signed prepared checked confirmed reported drawn labelled labeled annotated recorded entered sent edited verified uploaded submitted supplied taken collected"
    " erstellt geprüft bearbeitet gezeichnet freigegeben kontrolliert gemeldet bestätigt aufgenommen relu rédigé vérifié corrigé validé signé approuvé annoté envoyé saisi relue rédigée vérifiée corrigée validée signée approuvée annotée envoyée saisie".split()
)
DONE_TO = frozenset("call contact email ask tell thank ping notify inform phone cc met laut selon prévenir contacter contactez".split())
DONE_TO_2 = frozenset(map(tuple, (x.split() for x in "thanks to|thank you|spoke to|spoke with|speak to|speak with|talk to|talk with|talked to|talked with|met with|wrote to|write to|according to|demandez à|fragen sie".split("|"))))
AND = frozenset("and or und oder et ou".split())
DOES = re.compile(
    r"[  ](?:said|says|wrote|writes|asked|asks|called|calls|replied|replies|told|signed|phoned|emailed|explained|thinks|insisted|complained|resigned|apologised|apologized|sagte|sagt|schrieb|schreibt|fragte|fragt|rief|meinte|antwortete|unterschrieb|a dit|a écrit|a signé|a appelé|a répondu|a demandé|a confirmé|a relu|a corrigé|dit que|écrit que)\b"
)
FIELD_END = re.compile(r"[  ]*(?:$|[\n\r<(,;.|\])])")
LINE_END = re.compile(r"[ \t]*(?:[\r\n]|$)")
CLOSING = re.compile(r"(?:[Rr]egards|[Ww]ishes|[Ss]incerely|[Bb]est|[Cc]heers|[Tt]hanks|Thank you|Grüße|Grüßen|Gruß|Merci|Cordialement|Bien à vous),?[ \t]*\r?\n[ \t]*\Z")
SALUTATION = re.compile(rf"(?:^|(?<=[\n\r.!?] )|(?<=[\n\r]))[ \t>]*(?:Dear|Hi|Hello|Hey|Good morning|Bonjour|Salut|Cher|Chère|Hallo|Liebe|Lieber|Guten Tag|Sehr geehrter|Sehr geehrte),?[  ]{{1,2}}{_TITLED}?(?P<n>{_ONE})(?=[  ]?[,!:]|[  ]*[\n\r])", re.M)
SALUTATIONS = ("Dear", "Hi ", "Hi,", "Hello", "Hey", "Good morning", "Bonjour", "Salut", "Cher", "Chère", "Hallo", "Liebe", "Guten Tag", "Sehr geehrte")
TITLED = re.compile(rf"(?<![\w.])(?:Ms|Mrs|Mr|Miss|Dr|Prof|Herr|Herrn|Frau|Mme|Mlle|Monsieur|Madame|Captain|Capt)(?:\.|(?=[  ]))[  ]{{1,2}}{_TITLED}*(?P<n>{_ONE})")
TITLED_PARTS = ("Ms", "Mr", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Capt")


def _in_context(t: str, a: int, b: int, joined: bool) -> bool:
    """Whether a full name at t[a:b] stands where persons do. joined: an `and` leads to it from one that does."""
    line = max(t.rfind("\n", 0, a), t.rfind("\r", 0, a)) + 1
    # The words of the contexts are short: this much holds the longest of them and a title.
    before = t[max(line, a - 60) : a]
    if DOES.match(t, b):
        return True
    words = before.split()
    while words and words[-1].rstrip(".").lower() in TITLES:
        words.pop()
    if not words:
        return bool(line and CLOSING.search(t, max(0, line - 40), line) and LINE_END.match(t, b))
    last = words[-1].lower()
    if last[-1] in ":：" and FIELD_END.match(t, b):
        label = re.split(r"[.;,|(\[]", " ".join(words))[-1].lower().strip(" :：>*-\t")
        return label in FIELDS
    if last in DONE_TO or last in ("by", "von", "par") and len(words) > 1 and words[-2].lower() in DONE:
        return True
    return len(words) > 1 and (words[-2].lower(), last) in DONE_TO_2 or joined and last in AND


def _general(t: str) -> Iterator[tuple[int, int]]:
    """Spans that may be names by their context: full names, and single ones after salutations and titles."""
    end = -1
    for m in PAIR.finditer(t):
        a, b = m.span()
        joined = end >= 0 and t[end:a].strip() in AND
        starts = [w.start() for w in _WORDS.finditer(t, a, b) if t[w.start()].isupper()]
        # A cue at the beginning of a sentence has a capital too: the name may begin with a later word.
        for at in [a, *starts[1:-1]]:
            if _in_context(t, at, b, joined):
                yield at, b
                end = b
                break
    if any(w in t for w in SALUTATIONS):
        for m in SALUTATION.finditer(t):
            yield m.span("n")
    if any(w in t for w in TITLED_PARTS):
        for m in TITLED.finditer(t):
            yield m.span("n")


HAN_GENERAL = re.compile(r"(?:联系人|负责人|作者|姓名|收件人|发件人|审核|编辑|经办人|签名|签收人|申请人|客户)[：:][ ]?(?P<a>[一-鿿]{2,4})(?=[ 。，；、（(\n\r]|$)|请(?:找|联系|通知|询问)(?P<b>[一-鿿]{2,3})(?=确认|核对|处理|复核|[。，])|由(?P<c>[一-鿿]{2,3})(?=负责|审核|复核|确认|维护|签收|提交|录入)")
# Capitalised words of institutions, places, gear and programs, none of which end or begin a person's name.
NO_PERSON = frozenset(
    "Authority Harbor Harbour Sea Ocean Bay Port Island River Lake Coast North South East West Northern Southern Eastern Western Loader Module Model Learning Data Dataset Team Group Office Department Center Centre Institute University Company Service Services System Station Server Survey Manual Report Section Table Release Version Issue Error Batch Task Unit Lane Project Board Committee Council"
    " Agency Museum School Library Street Road Avenue Lane Drive Square Januar January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag Deep Machine Blue Red Green Black White New Old Great United General Data Quality Control Image Audio Video Text Sample Label Test Train Support Customer Help Desk Security Admin Human Resources".split()
)


def _emails(t: str) -> Iterator[tuple[int, int, str]]:
    at, last = t.find("@"), 0
    while at >= 0:
        a = at
        while a > last and t[a - 1] in LOCAL:
            a -= 1
        while a < at and not t[a].isalnum():
            a += 1
        right = DOMAIN.match(t, at + 1) if a < at else None
        if right:
            yield a, right.end(), "email"
        last = at + 1
        at = t.find("@", last)


def _ids(t: str) -> Iterator[tuple[int, int, str]]:
    low = t.lower()
    if any(w in low for w in ID_WORDS):
        for m in ID_LABEL.finditer(t):
            v = ID_VALUE.match(t, m.end())
            if v:
                yield *v.span(1), "id_number"
    for m in INSURANCE_SHAPE.finditer(t):
        a = m.start() - 3
        if a >= 0 and re.match("[A-Z]{2} ", t[a : a + 3]) and not t[a - 1 : a].isalnum():
            yield a, m.end(), "id_number"
    for m in IDENTITY_SHAPE.finditer(t):
        if IDENTITY_DATE.match(t, m.start()) and not (m.start() and t[m.start() - 1].isascii() and t[m.start() - 1].isalnum()):
            yield *m.span(), "id_number"


def _phones(t: str) -> Iterator[tuple[int, int, str]]:
    for run in DIGIT_RUN.finditer(t):
        at, end = run.span()
        while (m := PHONE.search(t, at)) and m.start() < end:
            a, b = m.span()
            if NOT_BEFORE_NUMBER.search(t, max(0, a - 10), a):
                at = a + 1
                while at < len(t) and t[at].isdigit():
                    at += 1
            else:
                yield a, b, "phone"
                at = b
    for run in HAS_DIGITS.finditer(t):
        m = SHORT_PHONE.match(t, run.start())
        if m and PHONE_CUE.search(t, max(0, m.start() - 60), m.start()) and sum(map(str.isdigit, m[0])) >= 6:
            yield *m.span(), "phone"


def _addresses(t: str) -> Iterator[tuple[int, int, str]]:
    for gate, pattern in zip(_GATES, ADDRESS, strict=True):
        if gate(t):
            for m in pattern.finditer(t):
                if not (m.start() and (t[m.start() - 1].isascii() and (t[m.start() - 1].isalnum() or t[m.start() - 1] in "-/."))):
                    yield *m.span(), "address"


def _bare(t: str, a: int, b: int) -> tuple[int, int, str] | None:
    """A name span without titles, or nothing if it starts like a sentence about something else."""
    while m := TITLE.match(t[a:b]):
        a += m.end()
    while a < b and t[a:b].split()[0].strip(",") in NOT_NAMES:
        rest = re.match(r"\S+\s+", t[a:b])
        if not rest:
            return None
        a += rest.end()
    return (a, b, "name") if b - a > 1 else None


def _names(t: str) -> Iterator[tuple[int, int, str]]:
    for cue, pattern, right in _CUES:
        if cue not in t:
            continue
        for m in pattern.finditer(t):
            n = _NAME.match(t, m.end())
            if n and n[0].split()[0].strip(",") not in NOT_NAMES and (cue not in STRICT or right.match(t, n.end())):
                if x := _bare(t, *n.span()):
                    yield x
            elif (n := _PLAIN.match(t, m.end())) and right.match(t, n.end()):
                yield *n.span(), "name"
    for verb in AFTER:
        at = t.find(verb)
        while at > 0:
            for a, b, kind in _ending(t, at):
                m = MONSIEUR.match(t[a:b]) if verb.startswith(" a ") else None
                yield a + (m.end() if m else 0), b, kind
            at = t.find(verb, at + 1)
    at = t.find(" <")
    while at > 0:
        close = HEADER.match(t, at + 2)
        if close:
            yield from _ending(t, at)
        at = t.find(" <", at + 1)
    if "--" in t:
        for m in SIGNATURE.finditer(t):
            if WHOLE.match(m[1]):
                if x := _bare(t, *m.span(1)):
                    yield x
    if HAN_GATE.search(t):
        for m in HAN_CUES.finditer(t):
            yield *m.span(m.lastgroup), "name"
    if "：" in t or "由" in t or "请" in t:
        for m in HAN_GENERAL.finditer(t):
            yield *m.span(m.lastgroup), "name"
    low = None
    for a, b in _general(t):
        if t.startswith(" a ", b) and (sir := MONSIEUR.match(t[a:b])):
            a += sir.end()
        x = _bare(t, a, b)
        words = re.findall(r"[^\s.,]{2,}", t[x[0] : x[1]]) if x else []
        if not words or any(w in NO_PERSON or w in NOT_NAMES for w in words):
            continue
        # A word that the text also writes small is an ordinary word.
        low = low if low is not None else frozenset(re.findall(r"[a-zà-ÿ]{2,}", t))
        if not any(w[1:].islower() and w.lower() in low for w in words):
            yield x


def _ending(t: str, at: int) -> Iterator[tuple[int, int, str]]:
    """The name that ends at this place."""
    begin = max(t.rfind(c, 0, at) for c in "\n\r.!?;:。：，；、") + 1  # names hold full stops only after initials
    while begin > 2 and t[begin - 1] == "." and t[begin - 2].isupper() and not t[begin - 3].isalnum():
        begin = max(t.rfind(c, 0, begin - 1) for c in "\n\r.!?;:。：，；、") + 1
    begin = max(0, begin - 2)
    for pattern in (_AT_END, _PLAIN_END, _HAN_END):
        if m := pattern.search(t, begin, at):
            if x := _bare(t, *m.span()):
                yield x
            return


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, type) of source characters, in order.

    Overlaps go to the earlier kind of: e-mail, identity number, phone, address, name; among names to the longer one.
    """
    if not text:
        return []
    norm = Normalised(text)
    t = norm.text
    taken: list[tuple[int, int, str]] = []
    names = sorted(_names(t), key=lambda x: x[0] - x[1])
    for found in (_emails(t), _ids(t), _phones(t), _addresses(t), names):
        for a, b, kind in found:
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))
    for full in {t[a:b] for a, b, kind in taken if kind == "name" and " " in t[a:b]}:  # the same name again, without a cue
        for m in re.finditer(rf"(?<!\w){re.escape(full)}(?!\w)", t):
            if all(m.end() <= x or m.start() >= y for x, y, _ in taken):
                taken.append((*m.span(), "name"))
    return sorted((*norm.span(a, b), kind) for a, b, kind in taken)


# ---- operators -----------------------------------------------------------------------------------------------------


def find(documents: DataFrame) -> DataFrame:
    """doc_id, pii_type, pii_text, start, stop: what was found, as it stands in the text (stop is exclusive).

    Null and empty texts hold nothing; whole texts are read, of any length; repeated rows give repeated results; extra
    columns are ignored. Nothing is shuffled.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for a, z, kind in spans(t):
                    for c, x in zip(cols, (d, kind, t[a:z], a, z), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], ["doc_id", "pii_type", "pii_text", "start", "stop"])

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(scan, "doc_id long, pii_type string, pii_text string, start int, stop int")


def redacted(text: str | None) -> tuple[str | None, int]:
    """The text with typed placeholders such as [EMAIL], and how many there are."""
    if text is None:
        return None, 0
    out, done, found = [], 0, spans(text)
    for a, b, kind in found:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join([*out, text[done:]]), len(found)


def redact(documents: DataFrame) -> DataFrame:
    """doc_id, text, replaced: every document with placeholders in place of what `find` reports; null stays null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [redacted(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["doc_id", "text", "replaced"])

    return documents.select("doc_id", "text").mapInArrow(scan, "doc_id long, text string, replaced int")
