"""Sentence boundaries across languages and scripts.

A text is cut into blocks at blank lines and, between characters of Japanese or Chinese, at line breaks. In a block the
possible ends (terminators of spaced scripts, full-width marks, dandas, blanks beside Thai) are the nodes of a lattice;
quotations and brackets are its levels, paired first, so that an end inside one leads to the end of that level or
nowhere. Each node is then judged by the words on both sides. In spaced scripts these are abbreviations, initials,
ordinals and opening words. Runs of spaceless scripts are segmented whole, by a lattice over the words of a public
vocabulary: predicates and final particles, bound particles and openers decide whether a Japanese mark belongs to a name,
quotative particles and verbs of saying whether a quotation goes on, the word behind a Thai blank whether it repeats the
one before. The script around each node decides how it is read, not the language tag. The work is linear in the block.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vocabulary import TOKENIZERS, lattice

# Abbreviations that never end a sentence before a capital, those that do so only before a number is not
# following, those that may end one; words that open sentences; months; words before German ordinals.
NEVER = frozenset(
    """dr prof mr mrs ms mme mlle mm m. sr. sra srta dra st lt. sgt capt gen. col. rev. hon e.g i.e cf vs viz z.b d.h u.a. o.ä. vgl ca approx aprox env esp p.ex p.ej bzw hr fr. frl
    lic ing dipl mag abb bd mgr mons pr т.е т.к проф им г-н г-жа св акад डॉ प्रो श्री c.-à-d bspw ggf evtl inkl zzgl resp sog lt nach i.d.r m.e s.o s.u incl excl est ed. trad""".split()
) | {"lt", "fr", "gen", "col", "sr", "m", "ed"}
NUMBERED = frozenset("no nos nr nrn fig figs sec secs ch chap vol eq eqs tab p pp art arts pág págs núm nº s ст рис стр п гл табл abschn kap zeile v ver vers".split())
FINAL = frozenset("etc usw al inc ltd co corp a.m p.m u.s.w u.s u.k т.д т.п др jr bros dept mfg ph.d m.d b.a m.a d.c usf".split())
OPENERS = frozenset(
    """the a an in on at it its is are was were does do did has have had can could will would should may might must this that these those there here he she they we you i who whom whose what
    which when where why how if then else and but or so yet for nor not no yes nothing nobody none one some any all each every both most many few please see set run use try add note compare well
    by after before since while until with without as from to of about over under between during once only even also however therefore thus still again now today later next first second finally
    my your our his her their its let make keep give go get put take call ask
    der die das den dem des ein eine einer einem einen wir ihr sie er es ich du am beim bei im in zum zur vom von mit nach laut lt wie warum wann wo wer was wenn weil dass aber und oder nicht kein keine
    auf aus für seit bis solange während
    le la les un une des l' nous vous ils elles il elle on je tu ce cette ces c'est au aux du de dans en pour par sur avec sans pourquoi comment quand qui que quoi où mais et ou ne pas cela
    el los las una unos unas nosotros ellos ellas usted yo tú esto esta este según por para con sin sobre desde hasta cuando donde qué quién cómo si pero y o no se su
    мы вы они он она оно я ты это этот эта эти почему как когда где кто что если но и или не в на с по за до от для""".split()
)
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
ORDINAL_CUES = frozenset("am beim zum vom im dem den der des das die bis seit ab nach jeder jedem jeden jedes dieser diesem diesen ihr ihrem seinem zur in mit vor unter unserem unser".split())
JA_CONTINUES = "と って という といった とか など なら も が は を に の で や から まで だ です".split()
ZH_SAYING = "说 說 道 写 寫 问 問 答 表示 回复 回覆 称 稱 喊 叫 想 指出 认为 認為 补充 提醒".split()
# Japanese and Chinese words that end a sentence before a mark; Japanese particles that can't open one (before more hiragana
# they are the beginning of another word), and those that can, before a comma.
FINAL_PARTICLES = "か ね よ な わ ぞ ぜ さ かな よね です ます ました でした ません しょう でしょう ましょう ください さい だ だった た る い う ない なかった ろ 了 吗 嗎 呢 吧 啊 呀 嘛 的".split()
JA_BOUND = "の を に が は へ も と や で から まで って という とか など".split()
JA_OPENERS = "が で と から".split()
PREDICATE_ENDS = "うくぐすつぬぶむるたいだ"
#: Behind a blank these repeat or close what stands before it.
TH_GOES_ON = "ๆ ฯลฯ ฯ".split()
#: Words that begin like a verb of saying.
ZH_NOUNS = "说明 說明 说法 說法 道路 道理 道具 问题 問題 写入 写法 想法 想象 答案 称为 稱為 喊声".split()

_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿。、！？「」『』（）【】《》〈〉，：；｡-ﾟ]")
_BLOCKS = re.compile(r"(?:\r\n|[\n\r\x85  ])(?:[^\S\r\n]*(?:\r\n|[\n\r\x85  ]))+[^\S\r\n]*")
_LINE = re.compile(r"[^\S\r\n]*(?:\r\n|[\n\r])[^\S\r\n]*")
_ENDS = re.compile(r"[.!?…。！？؟।॥．｡۔‼⁇⁈⁉]+|(?<=[฀-๿])[^\S\r\n]+|[^\S\r\n]+(?=[฀-๿])")
_CLOSERS = "\"'”’»›」』)]}）】》〉］"
_OPENERS = "\"'“‘«‹„‚「『([{（【《〈［¿¡"
_PAIRS = {"«": "»", "‹": "›", "“": "”", "„": "“”", "‚": "‘’", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "〝": "〟", "»": "«"}
_OPENED_BY = {c: [o for o in _PAIRS if c in _PAIRS[o]] for c in set("".join(_PAIRS.values()))}
_MARKS = re.compile("[\"" + re.escape("".join(sorted(set("".join(_PAIRS) + "".join(_PAIRS.values()))))) + "]")
_WORD_BEFORE = re.compile(r"(?:(?<=^)|(?<=[\s(\[{«“„\"'’,;:/–—-]))((?:[^\W\d_]{1,3}\.[ \xa0]?)*[^\W_]*[^\W\d_][\w’'-]*|\d+|[^\W\d_]+[-.][^\W\d_]+)$")
_NEXT = re.compile(r"[\"'“‘«‹„‚「『(\[{（¿¡\s]*([^\W_][\w’'-]*)")
_NAME = re.compile(r"[A-Z][A-Za-z0-9]*|[ァ-ヺー]+")
_RUN = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿]+|[฀-๿]+")
_KANA = re.compile(r"[぀-ヿ]")
_LATIN = re.compile(r"[A-Za-z0-9_.-]+[^\S\n]?")
#: Function words that the dictionary must hold.
_ALSO = tuple(sorted({*FINAL_PARTICLES, *JA_BOUND, *JA_CONTINUES, *ZH_SAYING, *ZH_NOUNS, *TH_GOES_ON} | {a + b for a in "说說写寫问問答" for b in "道"}))


def lattice_words(text: str, tokenizers: str = TOKENIZERS) -> list[str]:
    """Words of spaceless text."""
    return lattice(_ALSO, tokenizers).words(text)


class _Block:
    """A block of a text: its spaceless runs, segmented where they are asked for, and its blanks."""

    def __init__(self, text: str, a: int, b: int, tokenizers: str) -> None:
        self.text, self.a, self.b = text, a, b
        self.lattice = lattice(_ALSO, tokenizers)
        self._runs: list[tuple[int, int]] | None = None
        self._cut: dict[int, list[int]] = {}
        self._token: tuple[int, int, int, int] | None = None

    def _run(self, i: int) -> tuple[list[int], int] | None:
        """Where the words of the run around the character at i begin, its end included; and which of them holds i."""
        if self._runs is None:
            self._runs = [m.span() for m in _RUN.finditer(self.text, self.a, self.b)]
        n = bisect_right(self._runs, (i, 1 << 60)) - 1
        if n < 0 or self._runs[n][1] <= i:
            return None
        if n not in self._cut:
            s, e = self._runs[n]
            cuts = [s]
            for w in self.lattice.words(self.text[s:e]):
                cuts.append(cuts[-1] + len(w))
            self._cut[n] = cuts
        return self._cut[n], bisect_right(self._cut[n], i) - 1

    def before(self, i: int) -> str:
        """The word that ends at i, or nothing."""
        got = self._run(i - 1) if i > self.a else None
        return self.text[got[0][got[1]] : i] if got else ""

    def japanese(self, i: int) -> bool:
        """Whether the run that ends at i holds kana."""
        got = self._run(i - 1) if i > self.a else None
        return got is not None and _KANA.search(self.text, got[0][0], got[0][-1]) is not None

    def after(self, k: int) -> list[str]:
        """The words of the run from k on."""
        got = self._run(k) if k < self.b else None
        if not got:
            return []
        cuts = [k, *got[0][got[1] + 1 :]]
        return [self.text[x:y] for x, y in zip(cuts, cuts[1:])]

    def token(self, i: int) -> tuple[int, int, int, int]:
        """Start and end of what stands between blanks around i, the first sign of an address in it, its last = or /."""
        if self._token is None or not self._token[0] <= i < self._token[1]:
            text, s, e = self.text, i, i
            while s > 0 and not text[s - 1].isspace():
                s -= 1
            while e < self.b and not text[e].isspace():
                e += 1
            signs = [x for x in (text.find(c, s, e) for c in ("://", "www.", "@")) if x >= 0]
            self._token = (s, max(e, i + 1), min(signs, default=1 << 60), max(text.rfind("=", s, e), text.rfind("/", s, e)))
        return self._token


def _levels(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(opening, closing) positions of the quotations and brackets that are closed within the block, in order."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    opened = dict.fromkeys(_PAIRS, 0)
    straight = -1
    for m in _MARKS.finditer(text, a, b):
        i, c = m.start(), m.group(0)
        if c == '"':
            opens = i == a or text[i - 1].isspace() or text[i - 1] in "([{«“„—–"
            if straight < 0 and (opens or not text[i - 1].isalnum() and text[i - 1] not in ".!?,…"):
                straight = i
            elif straight >= 0 and not (opens and i + 1 < b and not text[i + 1].isspace() and text[i - 1].isspace()):
                out.append((straight, i))
                straight = -1
            elif straight >= 0:
                straight = i  # the one before was never closed
            continue
        if stack and c in _PAIRS.get(stack[-1][0], ""):
            opened[stack[-1][0]] -= 1
            out.append((stack.pop()[1], i))
        elif c in _PAIRS and c != "»":
            opened[c] += 1
            stack.append((c, i))
        elif c in "»›」』)]）】》〉”" and any(opened[x] for x in _OPENED_BY.get(c, "")):
            while c not in _PAIRS[stack[-1][0]]:  # closes an outer one: those within stay open
                opened[stack.pop()[0]] -= 1
            opened[stack[-1][0]] -= 1
            out.append((stack.pop()[1], i))
    return sorted(out)


def _in_name(block: _Block, start: int, i: int, k: int) -> bool:
    """Whether a full-width mark at text[i:k], the sentence having begun at start, stands inside a name: no predicate or
    final particle before it, and behind it a particle that can't open a sentence, or, if one name in Latin letters is
    all there is before an exclamation mark, the katakana that go on with the name."""
    text, before, after = block.text, block.before(i), block.after(k)
    if k - i != 1 or before in FINAL_PARTICLES or before[-1:] and before[-1] in PREDICATE_ENDS:
        return False
    if after and (before or text[i - 1 : i].isalnum()) and after[0] in JA_BOUND:
        n = k + len(after[0])
        if after[0] in JA_OPENERS and text[n : n + 1] == "、":
            return False
        # before more hiragana it may be the beginning of a word that the dictionary lacks
        if len(after) == 1 or not "ぁ" <= text[n] <= "ん" or len(after[1]) > 1:
            return True
    return text[i] in "！？" and bool(after) and "ァ" <= text[k] <= "ー" and _NAME.fullmatch(text, start, i) is not None and text[i - 1].isascii()


def _goes_on(block: _Block, i: int, k: int) -> bool:
    """Whether a sentence goes on behind a quotation that text[i:k] ends: a quotative particle in Japanese; in Chinese a
    comma, or a verb of saying in the clause that begins there."""
    text, after = block.text, block.after(k)
    if "぀" <= text[k] <= "ヿ" or block.japanese(i):
        return bool(after) and (after[0] in JA_CONTINUES or any(after[0] == x[: len(after[0])] and text.startswith(x, k) for x in JA_CONTINUES))
    if text[k] in "，、,：:；;":
        return True
    m = _LATIN.match(text, k, block.b)
    words = after or (block.after(m.end()) if m else [])
    return any(w in ZH_SAYING or len(w) == 2 and w[1] == "道" and w[0] in ZH_SAYING for w in words)


def _ends(block: _Block, i: int, j: int, k: int, quoted: bool, start: int) -> bool:
    """Whether the sentence that began at start ends at k, behind the marks text[i:j] and what they closed."""
    text, b = block.text, block.b
    n = k
    while n < b and text[n].isspace():
        n += 1
    if n >= b:
        return True
    gap, nxt, marks = n > k, text[n], text[i:j]
    wide = any(c in "。！？．｡" for c in marks)
    if wide or _CJK.match(nxt) and not gap and any(c in "!?" for c in marks):
        if not quoted:
            return nxt not in "」』”’）)】》" and (gap or j != k or not _in_name(block, start, i, k))
        return gap or nxt in _OPENERS or not _goes_on(block, i, k)
    if any(c in "।॥" for c in marks):
        return True
    if nxt in ",;:)]}»”’%/\\=&*+|<>@#~^_" or nxt in "–—-" and (quoted or gap):
        return False
    m = _NEXT.match(text, n, min(b, n + 60))
    word = m.group(1) if m else ""
    first = word[:1]
    lower, cased = first.islower(), first.lower() != first.upper()
    loud = any(c in "!?؟‼⁇⁈⁉" for c in marks)
    if not gap and not quoted and nxt not in "\"“«„(¿¡「『":
        return _no_blank(block, i, n, word, loud)
    if nxt not in _OPENERS and not nxt.isalnum() and not gap:
        return False
    named = re.match(r"[^\W\d]+(?:_\w|[A-Z]\w*(?:[.(:_]|\s|$))|v?\d", text[n : min(b, n + 40)]) is not None  # an identifier may stand first
    speech = nxt in "\"“«„「『‚‘"
    if lower and not (named or speech):
        return False
    if loud or quoted:
        return True
    if "…" in marks or j - i > 1:
        return not lower
    # a single full stop and a blank
    before = text[max(0, i - 40) : i]
    w = _WORD_BEFORE.search(before)
    token = w.group(1) if w else ""
    short = re.sub(r"[\s\xa0]", "", token).lower()
    if not token:
        return True
    if token.isdigit():
        if len(token) <= 2 and first.isupper():
            if word.lower() in MONTHS:
                return False
            cue = re.search(r"([^\W\d_]+)[\s\xa0]+$", before[: len(before) - len(token)])
            if cue and cue.group(1).lower() in ORDINAL_CUES and word.lower() not in ("der", "die", "das", "wir", "es", "the"):
                return False
        return True
    if short in NEVER or short.split(".")[-1] in NEVER and "." in short and short not in FINAL:
        return False
    if first.isdigit() and short.split(".")[-1] in NUMBERED:
        return False
    if short in FINAL:
        return True
    if len(token) == 1 and cased and (token.isupper() or not token.isascii() and token.isalpha()):
        return _after_letter(text, n, word, before, token)
    if len(token) == 1 and token.islower():
        return len(word) > 1 and word.lower() in OPENERS
    if len(token) == 1 and not cased and not token.isascii() and token.isalpha():
        return False  # a one-letter abbreviation of a script without case
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", short) and short not in FINAL:
        return word.lower() in OPENERS
    return True


def _after_letter(text: str, n: int, word: str, before: str, token: str) -> bool:
    """After a capital and a full stop: an initial, unless what follows opens a sentence."""
    after = text[n + len(word) : n + len(word) + 1]
    if len(word) == 1 and after == ".":
        return False
    if re.search(r"[^\W\d_]\.[\s\xa0]+$", before[: len(before) - 1]):
        return False  # the last of several initials
    return word.lower() in OPENERS or "_" in text[n : n + 40].split(" ")[0] or bool(re.match(r"[A-Z][a-z]+[A-Z]|\d", text[n : n + 20])) or text[n] in _OPENERS


_PLAIN = re.compile(r"[(\[\"'“«„¿¡]*[^\W\d_]+(?:[-’'][^\W\d_]+)*[)\]\"'”»]*")
_RIGHT = re.compile(r"[A-ZÀ-ÞА-Я][^\W\d_]*(?:[-’'][^\W\d_]+)*[,;:]?")
_RIGHT_SHORT = re.compile(r"[A-ZÀ-ÞА-Я][^\W\d_]*(?:\.{1,3}|…)[,;]?")
_CAMEL = re.compile(r"[^\W_]*?[a-z][A-Z]")


def _no_blank(block: _Block, i: int, n: int, word: str, loud: bool) -> bool:
    """A mark with no blank behind it ends a sentence only between a plain word and a capitalised one."""
    text, b = block.text, block.b
    if i == 0 or not word or text[n : n + 1] != word[:1]:
        return False
    start, stop, address, late = block.token(n)
    if address < i or late >= n:
        return False
    low = word.lower()
    if not word[:1].isupper():
        return word[:1].isalpha() and low[:1] == word[:1].upper() and loud
    size = i - start
    plain = _PLAIN.fullmatch(text, start, i) is not None and _CAMEL.match(text, start, i) is None
    right_plain = _RIGHT.fullmatch(text, n, stop) is not None
    if not right_plain and (low in NEVER or low in NUMBERED or low in FINAL or low in OPENERS):
        right_plain = _RIGHT_SHORT.fullmatch(text, n, stop) is not None
    if not right_plain:
        return loud and plain
    return low in OPENERS and size > 1 or plain and size > 1 and text[i - 1].islower() and text[start:i].lower() not in NEVER and stop < b


def _block(text: str, a: int, b: int, out: list[tuple[int, int]], tokenizers: str) -> None:
    block = _Block(text, a, b, tokenizers)
    levels = _levels(text, a, b)
    opened: list[tuple[int, int]] = []  # those that began before the place that is looked at, but for those that ended
    at = 0
    start = a
    done = a  # ends before this are behind us

    def around(i: int, k: int) -> tuple[int, int] | None:
        """The innermost level that began before i and ends at k or later."""
        nonlocal at
        while at < len(levels) and levels[at][0] < i:
            while opened and opened[-1][1] < levels[at][0]:
                opened.pop()
            opened.append(levels[at])
            at += 1
        while opened and opened[-1][1] < i:
            opened.pop()
        for level in reversed(opened):
            if level[1] >= k:
                return level
        return None

    for m in _ENDS.finditer(text, a, b):
        i, j = m.span()
        if i < done:
            continue
        if m.group(0).isspace():
            after = block.after(j)
            if around(i, i + 1) is None and not (after and block.before(i) and after[0] in TH_GOES_ON):
                _add(text, start, i, out)
                start = done = j
            continue
        k, quoted, inside = j, False, False
        while True:
            # out of every level that the marks (with blanks and further marks) close
            n = k
            while n < b and text[n] in " \xa0  　" :
                n += 1
            level = around(i, k)
            if level and level[0] >= start and level[1] == n:
                k, quoted = n + 1, True
                while k < b and text[k] in ".!?…。！？":
                    k += 1
                continue
            inside = bool(level and level[0] >= start)
            break
        if inside:
            continue
        while k < b and text[k] in "'’”»›" and not (k + 1 < b and text[k + 1].isalnum()):
            k, quoted = k + 1, True
        if _ends(block, i, j, k, quoted, start):
            _add(text, start, k, out)
            start = done = k
    _add(text, start, b, out)


def _add(text: str, s: int, e: int, out: list[tuple[int, int]]) -> None:
    while s < e and text[s].isspace():
        s += 1
    while e > s and text[e - 1].isspace():
        e -= 1
    if e > s:
        out.append((s, e))


def sentence_spans(text: str | None, tokenizers: str = TOKENIZERS) -> list[tuple[int, int]]:
    """(start, end) of the sentences in order, in code points, without blanks at either end."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    at = 0
    blocks = []
    for m in _BLOCKS.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for a, b in blocks:
        s = a
        if _CJK.search(text, a, b):
            for m in _LINE.finditer(text, a, b):
                if m.start() > s and (_CJK.match(text[m.start() - 1]) or m.end() < b and _CJK.match(text[m.end()])):
                    _block(text, s, m.start(), out, tokenizers)
                    s = m.end()
        _block(text, s, b, out, tokenizers)
    return out


def _batches(batches: Iterator[pa.RecordBatch], tokenizers: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            rows, order, starts, ends, texts = [], [], [], [], []
            for r, t in enumerate(part.column(part.num_columns - 1).to_pylist()):
                for n, (s, e) in enumerate(sentence_spans(t, tokenizers)):
                    rows.append(r)
                    order.append(n)
                    starts.append(s)
                    ends.append(e)
                    texts.append(t[s:e])
            kept = [c.take(pa.array(rows, pa.int32())) for c in part.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(order, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())],
                [*part.schema.names[:-1], "sentence_no", "start_char", "end_char", "sentence"],
            )


def split_sentences(documents: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row per sentence: the kept columns, sentence_no (0-based), start_char, end_char (code points, end exclusive)
    and sentence. Null, empty and blank texts have no sentence; repeated rows come out repeatedly; nothing is shuffled."""
    df = documents.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(lambda it: _batches(it, tokenizers), f"{kept}, sentence_no int, start_char bigint, end_char bigint, sentence string".removeprefix(", "))
