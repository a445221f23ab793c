"""The prose of a document: its own sentences without code, logs, tables, quotes, links and markup."""

from __future__ import annotations

import html
import re

#: Words of a window of sentences that is graded as one.
WINDOW_WORDS = 60
FENCED = re.compile(r"(?ms)^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)")
BLOCKS = re.compile(r"(?is)<(pre|code|blockquote|script|style|table)\b[^>]*>.*?(?:</\1\s*>|\Z)")
BREAKS = re.compile(r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|hr|tr|td)\b[^>]*>")
TAGS = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
LINKS = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)|\[([^\[\]]*)\]\[[^\[\]]*\]")
ADDRESS = re.compile(r"(?i)\b(?:https?|ftp)://\S+|\bwww\.\S+|[\w.+-]{1,64}@[\w-]{1,63}\.\w\S*")
INLINE_CODE = re.compile(r"`[^`\n]*`")
LOG_START = re.compile(r"\s*(?:(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[?\d\d:\d\d:\d\d)|(?:at\s+[\w.$]+\(|Traceback|File \"))")
LOG_LEVEL = re.compile(r"\b(?:ERROR|WARN|INFO|DEBUG|TRACE)\b.*[:=]")
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")
CODE_START = re.compile(
    r"\s*(?:[{}()\[\]]+\s*$|(?:def|class|import|from\s+\S+\s+import|return|public|private|static|void|var|let|const|function|#include|if\s*\(|for\s*\(|while\s*\(|else\b\s*[:{]|\}|@\w+|\$\s|>>>|//|/\*|#!)"
    r"|(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|INSERT|UPDATE|DELETE|CREATE|JOIN|HAVING)\b|[\w.\[\]]+\s*=\s*\S)"
)
CALL = re.compile(r"\w\(\w*(?:,\s*\w+)*\)\s*[;:{]")
OPERATORS = ("==", "!=", "&&", "||", "->", "=>")
SIGNS = re.compile(r"[{}\[\]<>|=;_\\^~*/]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+(?=[A-ZÀ-ÞА-Я0-9\"'“‘(])")
#: Chosen by hand, for tables without labels to learn languages from: frequent function words of English, and of other languages
#: in Latin script without words they share with English.
ENGLISH = frozenset(
    "the of and to a in is it that was for on are with as be this have from or had by not but what all were when we there can an your which their if will each about how up out them then she many some so these would other into has her him see than its who now my over did down only way could may been any new where most after before also through just because should such one you they i he at do no me our".split()
)
FOREIGN = frozenset(
    "der die das und ist nicht ich ein eine einen dem den des mit auf für von zu im wie auch noch wenn aber jetzt warum ob wird habe hat sind war "
    "le la les des une un et est pas je il elle que qui dans pour sur avec mais très où ça ce cette j'ai c'est du au plus sont était "
    "el los las y es una por con para pero muy está qué cómo del lo como más mi su he ha "
    "il di che è non per sono della questo ma anche "
    "het een van niet ik maar op te dat zijn met voor "
    "o os não que um uma mas muito foi está na".split()
) - frozenset("die war hat pour plus con met den".split())


#: A line without any of these is prose, unless it begins as code does.
SIGNAL = re.compile(r"[;{}\[\]<>|=_\\^~*/()$@&:]|\d\d")
CODE_STARTS = frozenset("def class import from return public private static void var let const function SELECT FROM WHERE GROUP ORDER INSERT UPDATE DELETE CREATE JOIN HAVING Traceback else".split())
INVISIBLE = re.compile("[\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad]+")
SPACES = re.compile("[\u00a0\u2009\u202f]")
ITEM = re.compile(r"^(?:[-*+•]|\d+[.)]|#{1,6})\s+")


def plain_text(text: str) -> str:
    """The lines of prose of a text, paragraphs kept apart by empty lines."""
    t = text.replace("\r\n", "\n").replace("\r", "\n")
    plain = t.isascii()
    if not plain:
        t = t.replace("\u2028", "\n").replace("\u2029", "\n\n")
    if "```" in t or "~~~" in t:
        t = FENCED.sub("\n\n", t)
    if "<" in t:
        t = BLOCKS.sub("\n\n", t)
        t = BREAKS.sub("\n\n", t)
        t = TAGS.sub(" ", t)
    if "&" in t:
        t = html.unescape(t)
        plain = t.isascii()
    if "](" in t or "][" in t:
        t = LINKS.sub(lambda m: f" {m[1] or m[2] or ''} ", t)
    if "://" in t or "www." in t or "@" in t:
        t = ADDRESS.sub(" ", t)
    if "`" in t:
        t = INLINE_CODE.sub(" ", t)
    if not plain:
        t = SPACES.sub(" ", INVISIBLE.sub("", t))
    out = []
    for line in t.split("\n"):
        s = line.strip()
        if not s:
            out.append("")
            continue
        if line.startswith(("    ", "\t", " \t")) or s.startswith((">", "|", "```", "~~~")) or s.endswith("|"):
            continue
        if SIGNAL.search(s) or s.split(None, 1)[0] in CODE_STARTS:
            if s[-1] in ";{}" or LOG_START.match(line) or CODE_START.match(line) or any(x in s for x in OPERATORS):
                continue
            if ("(" in s and CALL.search(line)) or (any(x in s for x in LEVELS) and LOG_LEVEL.search(line)):
                continue
            letters = sum(map(str.isalpha, s))
            if letters < 0.5 * (len(s) - s.count(" ")) or len(SIGNS.findall(s)) > 0.08 * len(s):
                continue
        out.append(ITEM.sub("", s))
    return "\n".join(out)


def sentences(paragraph: str) -> list[str]:
    return [s for s in SENTENCE.split(" ".join(paragraph.split("\n"))) if s.strip()]


PARAGRAPHS = re.compile(r"\n\s*\n")


def paragraphs(text: str) -> list[list[tuple[str, list[str]]]]:
    """The sentences of each paragraph of a text's prose with their words; those without words are left out."""
    out = []
    for paragraph in PARAGRAPHS.split(plain_text(text)):
        split = [(s, ws) for s in sentences(paragraph) if (ws := WORD.findall(s))]
        if split:
            out.append(split)
    return out


def group(sizes: list[int], english: list[bool], least: int = WINDOW_WORDS) -> list[tuple[int, int]]:
    """Cuts the sentences of a text, of which the words and the language are given, into windows [first, last).

    A window takes whole sentences, at least ``least`` words of them, and does not cross from English to another
    language; a sentence that is much longer stays whole. A short last window joins the one before it.
    """
    out: list[list[int]] = []
    size = 0
    for i, n in enumerate(sizes):
        if not out or english[i] != english[out[-1][0]] or size >= least:
            out.append([i, i])
            size = 0
        out[-1][1] = i + 1
        size += n
    if len(out) > 1 and size < least // 3 and english[out[-2][0]] == english[out[-1][0]]:
        end = out.pop()[1]
        out[-1][1] = end
    return [(a, z) for a, z in out]


def windows(text: str, least: int = WINDOW_WORDS) -> list[tuple[list[str], list[list[str]], bool]]:
    """(sentences, their words, English) of each window of at least ``least`` words of a text's prose.

    Without a learned model paragraphs are judged by the function words in them; a paragraph without any is taken
    for English if it is in Latin script with few accents.
    """
    split = paragraphs(text)
    english = [e for p in split for e in [is_english([w.lower().replace("’", "'") for _, ws in p for w in ws])] * len(p)]
    flat = [x for p in split for x in p]
    return [([s for s, _ in flat[a:z]], [ws for _, ws in flat[a:z]], english[a]) for a, z in group([len(ws) for _, ws in flat], english, least)]


def is_english(low: list[str]) -> bool:
    own = sum(w in ENGLISH for w in low)
    other = sum(w in FOREIGN for w in low)
    strange = sum(not w.isascii() and any(c > "ɏ" or c in "äöüßéèêëàâçñóíúáìòùîïôûœãõ" for c in w) for w in low)
    if strange > 0.3 * len(low):
        return False
    # learned prose can do with few function words, but then has none of another language
    return own >= other and strange <= 0.15 * len(low) and (own >= 0.08 * len(low) or other <= 0.04 * len(low))
