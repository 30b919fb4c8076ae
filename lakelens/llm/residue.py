"""Template residue, filler and error-page text: masked messages grouped across sources, groups classified by rules.

Texts are cut into segments (lines and sentences) outside quoted code. Segments that hold anything a rule could match are
masked (numbers, addresses, dates, names) and grouped by the exact hash of what is left; a group is counted over all
documents and sources. Only then are the groups classified, once for each distinct wording: a widely recurring message by
all phrase and placeholder rules, one that does not recur by those forms alone that are residue wherever they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from re import _parser

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A vague message is residue from so many sources (documents without a source count as one source) on.
WIDE = 3
_SHARES = 8  # parts of a message's documents that meet its verdict apart
CODE = re.compile(
    r"\.(?:py|pyi|js|mjs|jsx|ts|tsx|go|java|kt|rs|rb|cs|c|h|cc|cpp|hpp|php|swift|scala|sh|bash|sql|css|scss|html?|vue|lua|pl|r|ya?ml|toml|json|xml|ini|cfg|env|tf|proto|gradle|tmpl|j2|jinja|tpl|erb|hbs|mustache)$", re.I
)
_FENCE = re.compile(r"^[ \t>]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t>]*\1`*~*[ \t]*$|\Z)", re.S | re.M)
_TICKS = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\s\d])")
#: Tags that begin a part of a page; a line of mark-up is taken apart at them, however long it is.
_TAG = re.compile(r"(?i)(?=<(?:/?(?:html|head|body|title|h[1-6]|p|div|section|main|header|footer|article|center|noscript|form|ul|ol|li|table|tr|td|pre|blockquote)\b|br\b|hr\b|meta\b|link\b|!))")
_QUOTED = "\x01"  # stands for quoted code

# fixed values: placeholder forms of template languages and forms for people to fill in
_FIELD = re.compile(
    r"\{\{\{?\s*[\w .|-]{1,60}\}?\}\}|\{%-?\s*[\w .=\"'-]{1,60}-?%\}|<%[=-]?\s*[\w .()-]{1,60}%>|\$\{\s*[A-Za-z_][\w .-]{0,60}\}|\[\[\s*[a-z][a-z0-9_ -]{1,60}\]\](?!\()|@@[A-Za-z][\w-]{1,60}@@|%\([a-z_]\w{0,60}\)[sd]"
    r"|%%[A-Z][A-Z_]{2,60}%%|__[A-Z][A-Z_]{3,60}__|#\{[a-z_]\w{1,60}\}|(?<!\w)<(?:[A-Z][A-Z0-9]{2,}|[A-Z][A-Z0-9]+[ _-][A-Z0-9]+)(?:[ _-][A-Z0-9]+)*>|\[[A-Z]{3,}(?:[ _][A-Z]{2,})*\](?!\()"
)
_PROMPT = re.compile(
    r"(?i)[<\[(]\s*(?:your|insert|enter|add|fill in|replace|put|choose|type|todo:? (?:your|insert|fill)|e\.g\. your)\b[^<>\[\]()\n]{0,80}[>\])](?!\()|[<\[(]\s*[\w -]{2,50} (?:goes|go) here\s*[>\])]"
    r"|^\W*[\[(<](?:describe|explain|state|list|write|summari[sz]e|provide|give|specify|outline|name|what|why|how|who)\b[^\[\]()<>\n]{2,120}[\])>]\W*$"
    r"|\b(?:your|the|some) (?:content|text|title|description|name|summary|message|headline|heading|copy|paragraph)s? (?:goes|go|comes|will go) here\b"
)
_BLANKS = re.compile(
    r"(?i)^\W*(?:write|describe|enter|insert|add|put|provide|type) (?:a |an |the |your )?[\w ,'-]{2,70} here\W*$|^\W*describe what you (?:expected|did|saw)[\w ]*\W*$|^\W*(?:\d+[.)] )?(?:first|second|third|next) step\W*$|^\W*(?:\[ ?\] ?)?item (?:one|two|three|\d)\W*$"
    r"|^\W*(?:a clear and concise description of|please (?:fill (?:in|out)|replace|delete) (?:this|the)) [^\n]{3,120}$|^\W*(?:click|tap) (?:here )?to (?:add|edit|enter) (?:text|title|content|subtitle)\b"
)
_FILLER = re.compile(r"(?i)\blorem ipsum\b|\bdolor sit amet\b|\bconsectetur adipis|^\W*(?:this is (?:a |an |some )?)?(?:placeholder|dummy|filler|sample|blind|example)[ -]?(?:text|paragraph|content|copy|sentence|heading|headline|title)(?: (?:number|no\.?|nr\.?)? ?\d+)?\W*$|\b(\w{3,12})(?:[ ,.]+\1\b){4,}|\bthe quick brown fox jumps over\b|\b(?:asdf|qwerty|blah|foo bar baz)(?:[ ,]+\w*){0,1}[ ,]+(?:asdf|qwerty|blah)\b")
_STATUS = r"(?:400 bad request|401 unauthori[sz]ed|402 payment required|403 forbidden|404 (?:page )?not found|405 method not allowed|408 request time-?out|410 gone|413 (?:payload|content|request entity) too large|418 i'm a teapot|429 too many requests|451 unavailable for legal reasons|500 internal server error|501 not implemented|502 bad gateway|503 service (?:temporarily )?unavailable|504 gateway time-?out|520 [\w ]*error|522 connection timed out|524 a timeout occurred)"
# fixed values: wordings of servers and viewers, by kind
_SERVER = re.compile(
    rf"(?i)^\W*{_STATUS}\W*$|<(?:title|h1)>\s*(?:error )?[45]\d\d\b|^\W*(?:http )?error:? [45]\d\d\W*$|^\W*(?:--+ ?)?content unavailable\b"
    rf"|^\W*(?=\{{.*\b(?:[45]\d\d|error|denied|forbidden|unauthori[sz]ed|time-?out|unavailable|not found|failed|invalid)\b)\{{\s*\"(?:error|message|detail|title|fault|status|code)\"\s*:"
    rf"|^\W*(?:the )?(?:remaining|rest of)\b.{{0,60}}\b(?:failed to load|could not be|cannot be|is unavailable)|^\W*[\[(-].{{0,80}}\b(?:failed to load|unavailable|not available|could not be (?:loaded|shown))\b.{{0,60}}[\])-]\W*$"
    rf"|^\W*error (?:while )?loading\b.{{0,60}}\b(?:page|content|document|resource|text|file|image|section)\b|\b(?:rest|remainder) of (?:this|the) (?:page|document|content) (?:could not|cannot|can't|failed)"
    rf"|^\W*access (?:to this (?:page|resource|site) (?:is |has been )?)?denied\W*$|^\W*you (?:do not|don't) have (?:the )?(?:permission|access|rights?)\b.{{0,30}}\b(?:to (?:view|access|open|see|read)|on this server)|^\W*(?:permission denied|forbidden|unauthori[sz]ed|bad gateway|gateway time-?out|service unavailable|internal server error|too many requests|request timed out|page not found|not found)\W*$"
    rf"|^\W*(?:the|this) (?:page|file|document|resource|url|link|item|content|site)\b.{{0,60}}\b(?:could not|cannot|can not|can't) be (?:found|displayed|loaded|opened|reached|shown)\b|^\W*it (?:may|might) have been (?:moved|deleted|removed|renamed)\b|\bthe requested (?:url|page|resource|document)\b.{{0,60}}\b(?:was not found|not found|could not be|does not exist|is not available)"
    rf"|^\W*(?:oops\W+)?something went wrong(?: on our (?:side|end))?\W*(?:$|try|please)|^\W*(?:oops|whoops|sorry)\W+(?:something|an error|the page|we|that)\b.{{0,60}}\b(?:wrong|error|find|found|occurred|exist)|^\W*an? (?:unexpected |unknown |internal )?error (?:has )?occurred\W*(?:$|while|please)"
    rf"|^\W*upstream connect error\b|^\W*fatal: (?:could not read|unable to access|repository|authentication failed)|^\W*(?:remote|ssh|error): .{{0,60}}\b(?:access denied|permission denied|refused|not found|unauthorized)\b|^\W*(?:api )?rate limit (?:reached|exceeded)\b.{{0,80}}(?:retry|try|$)"
    rf"|^\W*(?:the|this|our) (?:service|site|server|website|page|system)s? (?:is|are) (?:currently |temporarily )?(?:down|offline|unavailable|under maintenance|undergoing|closed)\b.{{0,80}}(?:maintenance|returns|back|later|soon|$)|^\W*(?:down|closed) for (?:scheduled |planned )?maintenance\b"
    rf"|^\W*(?:please )?(?:sign|log) ?in (?:again )?to (?:continue|read|view|see|access|proceed|your)\b|^\W*your session has (?:expired|timed out|ended)\b|^\W*(?:subscribe|register|upgrade)(?: now)? to (?:continue|read|view|unlock)\b|^\W*this (?:content|page|document|file|preview|video|image) is (?:not|no longer|currently not|currently un) ?available"
    rf"|^\W*(?:this (?:file|document|diff|image) is )?too large to (?:display|preview|render|show)\b|^\W*(?:no preview|preview (?:is )?(?:not|un)available|(?:cannot|can't|unable to|could not|failed to) (?:preview|display|render|load|open|show)(?: the| this| remaining| rest)*\b.{{0,80}}$)|^\W*(?:connection|request) (?:timed out|reset|refused)\W*(?:$|by)"
    rf"|page (?:introuvable|non trouvée)|accès (?:refusé|interdit)|erreur (?:du |de )?serveur|service (?:momentanément )?indisponible|página no encontrada|acceso denegado|error del servidor|servicio no disponible|seite (?:wurde )?nicht gefunden|(?:zugriff|zugang) verweigert|serverfehler|dienst (?:ist )?nicht (?:verfügbar|erreichbar)|pagina non trovata|accesso negato|страница не найдена|доступ запрещ|ページが見つかりません|页面(?:不存在|未找到)|访问被拒绝"
)
_SCRIPT_WORD = r"(?:java ?scripts?|scripts?|scripting|cookies?|skripte?)"
_SCRIPTS = re.compile(
    rf"(?i)<noscript\b|\b(?:enable|activate|allow|turn on|switch on|unblock|permit) (?:\w+ ){{0,2}}{_SCRIPT_WORD}\b|\bturn (?:java)?scripts? on\b|\b{_SCRIPT_WORD}(?: (?:and|or) {_SCRIPT_WORD})? (?:is|are|must be|has been|have been|seems? to be|appears? to be|needs? to be|should be|was) (?:currently )?(?:disabled|blocked|switched off|turned off|off|not enabled|required|allowed|enabled|needed|unavailable|deactivated)\b"
    rf"|\b(?:requires?|needs) {_SCRIPT_WORD}(?: (?:and|or) {_SCRIPT_WORD})?(?: (?:to (?:run|work|function|be (?:enabled|on|allowed))|enabled|switched on|turned on))?\W*$|^\W*checking your browser\b|\b{_SCRIPT_WORD} (?:ist|sind) (?:deaktiviert|ausgeschaltet|blockiert|abgeschaltet)|\baktivieren sie (?:bitte )?{_SCRIPT_WORD}|\b(?:bitte )?{_SCRIPT_WORD} aktivieren"
    rf"|\b{_SCRIPT_WORD} (?:est|sont) (?:désactivée?s?|bloquée?s?)|\bactive[zr] (?:le |les )?{_SCRIPT_WORD}|\b(?:active|habilite|activa|habilita|activar|habilitar) (?:el |las |los )?{_SCRIPT_WORD}|\b{_SCRIPT_WORD} (?:está|están) (?:desactivad|deshabilitad|bloquead)|\b(?:abilita|attiva)(?:re)? {_SCRIPT_WORD}|включите {_SCRIPT_WORD}|{_SCRIPT_WORD}を有効|启用 ?{_SCRIPT_WORD}"
)
_VAGUE = re.compile(r"(?i)\b(?:error|erreur|fehler|denied|forbidden|unavailable|not found|went wrong|timed? ?out|has expired|session expired|sign in|log in|maintenance|try again|javascript|cookies?|captcha|robots?)\b|\b(?:code|código|erreur|error|status)\W{0,3}[45]\d\d\b")
# text of an author about such things
_ABOUT = re.compile(r"(?i)\b(?:we|i|our|users?|nobody|because|retried|retries|since|until|whenever|when|if|answers?|sends?|returns? (?!at)|logs?|rejects?|replaced|dropped|fixtures?|tests?|reports? (?:such|that|an?)|gives up|works without|only for|reviewers?|in version|instead of|should)\b")
_NOTE = re.compile(r"^\W*(?:todo|fixme|xxx|hack|note)\b(?!.*\b(?:your|insert)\b)", re.I)
_LATIN = re.compile(r"(?i)\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|fugiat|eiusmod|incididunt|aliqua)\b")
_DUMMY, _FUNCTION_WORDS = re.compile(r"(?i)\b(?:lorem|ipsum|consectetur|adipiscing|fugiat|eiusmod|incididunt)\b"), re.compile(r"(?i)\b(?:the|of|to|is|are|was|were|and|or|for|with|by|this|that|be|not|from|but|it|as)\b")
#: Words from which on a segment around one of those words without any function word is filler, whatever its other words.
_FILLER_WORDS = 6
# fixed values: words of those who report on a server's message
_REPORTED = re.compile(r"(?i)\b(?:because|since|until|retr(?:ies|ied)|we (?:saw|see|got|get)|users?|customers?|reviewers?|gives? up|lists|fixtures?)\b")
_REPEATED = re.compile(r"\b(\w{3,12})[ ,.]+\1\b[ ,.]+\1\b")
# fixed values: alternatives of rules (by their beginnings) that hold no fixed words, or too common ones, and the shapes looked for instead
_SHAPED = (
    r"(?<!\w)<(?:[A-Z]", r"\[[A-Z]{3,}", r"(?i)[<\[(]\s*(?:your|insert", r"^\W*[\[(<](?:describe", r"\b(\w{3,12})(?:[ ,.]+\1", r"\b(?:code|código",
)
_SHAPES = (
    re.compile(r"<[A-Z]|\[[A-Z]{3}"),
    re.compile(r"(?i)[<\[(][^\S\n]*(?:your|insert|enter|add|fill in|replace|put|choose|type|todo|e\.g\. your|describe|explain|state|list|write|summari[sz]e|provide|give|specify|outline|name|what|why|how|who)\b"),
    re.compile(r"(?i)\b(?:code|código|erreur|error|status)\W{0,3}[45]\d\d\b"),
)
_MASKS = (
    (re.compile(r"https?://\S+|\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b|\b(?:[a-z0-9-]+\.)+(?:com|org|net|io|dev|example|test|invalid|local)\b", re.I), "<address>"),
    (re.compile(r"\b\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?(?:\.\d+)?Z?)?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}:\d\d(?::\d\d)?\b"), "<date>"),
    (re.compile(r"\b(?=\w*\d)[0-9a-f]{6,}\b"), "<id>"),
    (re.compile(r"\b[A-Za-z]+(?:_[A-Za-z0-9]+)+\b"), "<name>"),
    (re.compile(r"\d+(?:[.,]\d+)*"), "<n>"),
)


def alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a regular expression."""
    parts, depth, inside, at, k = [], 0, False, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            parts.append(pattern[at:k])
            at = k + 1
        k += 1
    return [*parts, pattern[at:]]


def _weight(words: set[str]) -> tuple[int, int]:
    return min((sum(1 if c.isascii() else 3 for c in w) for w in words), default=0), -len(words)


def _words(tree) -> tuple[set[str] | None, set[str] | None]:
    """(all strings a parsed expression matches, if they are few; strings of which each match holds one, if there are any)."""
    whole, run, best = True, {""}, None

    def offer(words: set[str] | None) -> None:
        nonlocal best
        least = 3 if words and any(w[:2].isalpha() for w in words) else 2
        if words and _weight(words)[0] >= least and (best is None or _weight(words) > _weight(best)):
            best = words

    for op, value in tree:
        exact = held = None
        op = str(op)
        if op == "LITERAL":
            exact = {chr(value).lower()}
        elif op in ("AT", "ASSERT", "ASSERT_NOT"):
            exact = {""}
        elif op == "IN" and len(value) <= 4 and all(str(o) == "LITERAL" for o, _ in value):
            exact = {chr(v).lower() for _, v in value}
        elif op == "SUBPATTERN":
            exact, held = _words(value[3])
        elif op == "BRANCH":
            each = [_words(x) for x in value[1]]
            exact = set().union(*(e for e, _ in each)) if all(e is not None for e, _ in each) else None
            held = set().union(*(h for _, h in each)) if all(h for _, h in each) else None
        elif op == "MAX_REPEAT" and value[0] <= 1:
            exact, held = _words(value[2])
            exact = (exact if value[0] else {"", *exact}) if exact is not None and value[1] == 1 else None
            held = held if value[0] else None
        elif op == "MAX_REPEAT":
            held = _words(value[2])[1]
        if exact is not None and len(exact) * len(run) <= 256:
            run = {a + b for a in run for b in exact}
            continue
        offer(run)
        offer(held)
        whole, run = False, exact or {""}
        if exact:
            offer(exact)
    offer(run)
    return (run if whole else None), best


@cache
def fragments() -> frozenset[str]:
    """Lower-case strings, derived from the rules, of which every match holds one or one of the shapes."""
    found: set[str] = set()
    for rule in (_FIELD, _PROMPT, _BLANKS, _FILLER, _SERVER, _SCRIPTS, *map(re.compile, alternatives(_VAGUE.pattern))):
        for alternative in alternatives(rule.pattern):
            if alternative.startswith(_SHAPED):
                continue
            words = _words(_parser.parse(alternative))[1]
            if not words:
                raise ValueError(f"neither fixed words nor a shape: {alternative}")
            found |= words
    # three different ones make filler, so the two that are parts of common words need not be looked for
    found |= _words(_parser.parse(_LATIN.pattern))[1] - {"amet", "elit"}
    return frozenset(w for w in found if not any(v != w and v in w for v in found))


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for fragment in fragments():
        found.add_word(fragment, True)
    found.make_automaton()
    return found


def without_code(text: str) -> str:
    """The text with fenced blocks and backticked spans replaced by one mark each."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(_QUOTED, text)
    return _TICKS.sub(_QUOTED, text) if "`" in text else text


def masked(segment: str) -> str:
    """Lower-cased with addresses, dates, ids, names and numbers masked, white space collapsed."""
    for pattern, mark in _MASKS:
        segment = pattern.sub(mark, segment)
    return " ".join(segment.lower().split())


def _lines(text: str) -> Iterator[str]:
    """Lines with anything that a rule could need; the others are never looked at."""
    low = text.lower()
    if len(low) != len(text) or "ſ" in low or "ı" in low:  # positions moved, or letters that only rules fold: look at every line
        yield from text.split("\n")
        return
    marks = {end for end, _ in _automaton().iter(low)}
    marks.update(m.start() for shape in _SHAPES for m in shape.finditer(text))
    marks.update(m.start() for m in _REPEATED.finditer(low))
    done = -1
    for at in sorted(marks):
        if at <= done:
            continue
        start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        done = end = len(text) if end < 0 else end
        yield text[start:end]


def segments(text: str) -> Iterator[str]:
    """Sentences, and short or marked-up lines as a whole, of the lines that may hold residue."""
    for line in _lines(text):
        line = line.strip()
        if len(line) < 3:
            continue
        parts = _SENTENCE.split(line)
        if len(parts) == 1 or len(line) < 120 or line[:1] in "<{":
            yield line
        if len(parts) > 1:
            yield from parts
        if "<" in line and classify(line) not in ("error", "script", "filler"):  # a page that is clear as a whole is one message
            yield from _marked_up(line)


def _marked_up(line: str) -> Iterator[str]:
    """The parts of a line of mark-up from tag to tag, and the sentences of each; scripts and styles are no text."""
    parts = _TAG.split(re.sub(r"(?i)<(script|style)\b.*?(?:</\1\s*>|$)", "<br>", line))
    for part in parts if len(parts) > 1 else ():
        part = part.strip()
        if not part:
            continue
        yield part
        text = re.sub(r"^<[^<>]*>\s*", "", part)
        if len(text) > 2 and text != part:
            yield text
        sentences = _SENTENCE.split(text)
        if len(sentences) > 1:
            yield from sentences


def _latin(segment: str) -> bool:
    """Three words of the classic filler text, or one of its unmistakable ones in prose without any function word."""
    if len(set(x.lower() for x in _LATIN.findall(segment))) >= 3:
        return True
    return bool(_DUMMY.search(segment)) and len(segment.split()) >= _FILLER_WORDS and not _FUNCTION_WORDS.search(segment)


def classify(segment: str) -> str:
    """"template", "filler", "error", "script" for clear residue, "vague" for a possible message, "" otherwise."""
    if _NOTE.match(segment):
        return ""
    if _FIELD.search(segment) or _PROMPT.search(segment):
        return "template"
    quoted = _QUOTED in segment
    if not quoted and _BLANKS.search(segment):
        return "template"
    if not quoted and (_FILLER.search(segment) or _latin(segment)):
        return "filler"
    about = quoted or bool(_ABOUT.search(segment))
    if not quoted and _SCRIPTS.search(segment) and not (about and not re.search(r"(?i)<noscript|(?:your|this) browser|this (?:page|site|app|viewer)", segment)):
        return "script"
    if not quoted and _SERVER.search(segment) and not _REPORTED.search(segment):
        return "error"
    return "vague" if not about and _VAGUE.search(segment) else ""


def _segments_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc, source, text in zip(pdf["doc_id"].tolist(), pdf["source"].tolist(), pdf["text"].tolist()):
            for segment in dict.fromkeys(segments(without_code(text))):
                rows.append((doc, source, xxhash.xxh64_intdigest(masked(segment)) - (1 << 63), xxhash.xxh64_intdigest(segment) - (1 << 63), segment))
        yield pd.DataFrame(rows, columns=["doc_id", "source", "message", "wording", "segment"])


def messages(documents: DataFrame) -> DataFrame:
    """(doc_id, source, message, wording, segment): the segments that a rule could match, not classified yet.

    message is the hash of the masked form, wording that of the segment. Source files and NULL or empty texts have none.
    """
    code = (F.coalesce(F.col("doc_kind") == "source", F.lit(False))) | F.coalesce(F.col("path").rlike(f"(?i){CODE.pattern}"), F.lit(False))
    prose = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~code)
    return prose.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInPandas(_segments_of, "doc_id long, source string, message long, wording long, segment string")


def _classified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.assign(kind=[classify(s) for s in pdf["segment"]])
        yield pdf.loc[pdf["kind"] != "", ["message", "wording", "kind", "sources"]]


def judged(found: DataFrame, wide: int = WIDE) -> DataFrame:
    """(message, wording, kind, sources): the wordings that are residue, with the number of sources that hold their message.

    Grouping comes first: messages are counted over distinct sources, and every distinct wording is classified once. A
    vague wording is residue where its message recurs in ``wide`` sources or has a wording of a clear kind.
    """
    spread = found.groupBy("message", F.coalesce("source", F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("n")).groupBy("message").agg(F.count(F.lit(1)).alias("sources"))
    wordings = found.groupBy("message", "wording").agg(F.min("segment").alias("segment"))
    kinds = wordings.join(spread, "message").mapInPandas(_classified, "message long, wording long, kind string, sources long")
    clear = F.max(F.when(F.col("kind") == "vague", 0).otherwise(1)).over(Window.partitionBy("message"))
    return kinds.withColumn("clear", clear).where((F.col("clear") == 1) | (F.col("sources") >= wide)).drop("clear")


def residue(documents: DataFrame, stage, wide: int = WIDE) -> DataFrame:
    """One row per document with residue: doc_id, kinds (sorted, comma-separated), n_messages, widest (sources of its widest message).

    documents: doc_id, text, source, doc_kind, path. Messages are counted over the distinct sources of all documents,
    map-side first; documents meet the verdict on a message in ``_SHARES`` parts, so that one a third of all documents hold
    is no burden on one task. A NULL source counts as one source, NULL kind and path as prose. Repeated rows count once.
    """
    found = stage(messages(documents), "residue-messages")
    verdicts = judged(found, wide).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))
    placed = found.select("doc_id", "message", "wording", F.pmod(F.xxhash64("doc_id"), F.lit(_SHARES)).cast("int").alias("share"))
    kept = placed.join(verdicts, ["message", "wording", "share"])
    return kept.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.countDistinct("message").alias("n_messages"), F.max("sources").alias("widest"))
