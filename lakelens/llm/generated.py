"""Files nobody on the project wrote by hand: generated, minified, vendored, data stored as code.

Every piece of a file gives sums (characters, compressed bytes, token and character entropy, identifier lengths, comment
density and the like) that add up to features of the file. A random forest learns on them from files that say what they are
in a header notice: that a tool wrote them, or that their own project owns them. Notices, the comments that hold them, and
paths are hidden from the features. A file is a case by its own notice, by the place or name it is kept under, by holding
nothing but literals, or by the forest, which finds what carries no notice.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled files of either class the forest is fitted on, at most.
SAMPLE = 8_000
TREES, TREE_DEPTH = 40, 8
#: Chance from which on a file is a case.
CHANCE = 0.5
#: Notices count in comments that begin among so many first lines of the file, and of every piece, and in all that follows
#: of a comment which begins there.
HEADER_LINES, PIECE_LINES = 25, 8

# fixed values: places for third-party code, and names of tool output
_PLACE = re.compile(
    r"(?:^|/)(?:vendor|_vendor|vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|pods|carthage|externs?|externals?"
    r"|deps|site-packages|dist-packages|godeps)/",
    re.I,
)
_NAME = re.compile(
    r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|[^/]*[.-]lock(?:\.json|\.yaml)?|[^/]*\.lockb?|go\.sum|gradle\.lockfile|pnpm-lock\.yaml"
    r"|[^/]*\.(?:min|bundle|chunk|prod)\.(?:js|mjs|css)|[^/]*[.-][0-9a-f]{8,20}\.(?:js|css)|[^/]*\.tab\.[ch](?:pp)?|lex\.yy\.c|[^/]*\.(?:pb|pb2|grpc|gen|generated|g|designer)\.\w+|[^/]*_(?:pb2|pb2_grpc|generated|gen)\.\w+|zz_generated\.[^/]*)$",
    re.I,
)
_TOOL_PLACE = re.compile(r"(?:^|/)(?:generated|__generated__|autogen|gen-src|generated-sources)/", re.I)
_PROSE = re.compile(r"\.(?:md|rst|txt|ya?ml|toml|ini|cfg|sh|bash)$|(?:^|/)\.env[^/]*$|\.env$", re.I)

# notices, as tools and licences word them
_TOOL = re.compile(
    r"(?i)\bcode generated\b.{0,80}\bdo not edit|@generated\b|<auto-?generated\b|\bauto-?generated\b.{0,60}\b(?:file|on build|by|from|do not|changes)\b|\bthis file (?:is|was|has been) (?:auto-?|automatically )?(?:generated|produced|created|written) by"
    r"|\bgenerated (?:automatically )?(?:from|by|with|using)\b.{0,60}(?:\bat revision\b|\bdo not\b|\bversion\b|\bv?\d+\.\d+|\.(?:proto|xsd|idl|thrift|g4|y|tmpl|wsdl)\b)|\bmachine[- ](?:written|generated) by\b|\bgenerated\b.{0,40}\bdo not (?:edit|modify|change)\b"
    r"|\b(?:do not|don't) (?:edit|modify|change)\b.{0,40}\b(?:generated|overwritten|by hand)\b|\bmanual changes will be (?:overwritten|lost)\b"
    r"|\bregenerate (?:with|by|using|via)\b.{0,80}\b(?:edits?|changes)\b.{0,20}\b(?:lost|overwritten|discarded)\b|\b(?:hand|manual) edits? (?:are|will be) (?:lost|overwritten)\b"
    r"|\bfichier (?:est|a été) (?:produit|généré|créé).{0,60}(?:ne pas|automatiquement)|\bne pas (?:le )?modifier à la main|\barchivo (?:fue |ha sido )?generado|\bno (?:lo )?(?:edite|modifique|editar|modificar)\b.{0,20}\bmano|\bnicht von hand (?:ändern|bearbeiten)"
    r"|automatisch (?:erzeugt|generiert)|généré automatiquement|generado automáticamente|сгенерирован автоматически|自動生成|自动生成"
)
_BUILT = re.compile(r"/\*!? ?built [\dT:-]{6,}")
_MAPPED = re.compile(r"(?:^|(?<=[;})\s]))(?://|/\*)[#@] ?sourceMappingURL=[^\s'\"`]+\s*(?:\*/)?\s*$", re.M)  # ends a file or a part of it
_ORIGIN = re.compile(
    r"(?i)\b(?:copied|vendored|imported|taken|adapted|forked|ported) (?:verbatim |unmodified )?from ([\w.@/-]+)"
    r"|\bpart of ([\w.-]+),? (?:version|v)\W?\d|\bupstream(?: project)?: ?([\w.-]+)@?|\bSPDX-License-Identifier: ?(?:LicenseRef-)?([\w.-]+)"
    r"|^\W*([\w.-]+) v?\d+\.\d+[\d.]* *(?:\||-|–|\().*(?:\(c\)|copyright|licen[cs]e|https?://)|\bcopyright (?:\(c\) )?\d{4}(?:-\d{4})?,? (?:the )?([\w.-]+) (?:authors|contributors|developers|project)\b|\bdistributed unmodified\b"
)
_COMMENT = re.compile(r"^\s*(?://+!?|#+|/\*+!?|\*+(?!/)|--|;+|<!--|\"{3}|'{3}|%|- )")
_NO_HEADER = re.compile(r"\s*(?:- |#\s*(?:include|define|undef|if|ifdef|ifndef|else|elif|endif|pragma|import|region)\b)")  # like comments, but no header
_BLOCK = re.compile(r"/\*.*?\*/", re.S)
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|[^\s\w]")
_SHAPE = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|\"[^\"\n]*\"|'[^'\n]*'")
# possessive, so that a line of any length is read once
_LITERALS = re.compile(r"^[\s\[\](){},;:+-]*+(?:(?:0x[0-9a-fA-F]++|\d[\d.eE+-]*+|\"[^\"]*+\"|'[^']*+'|null|true|false|None)[\s\[\](){},;:+\\-]*+)++$|^\s*+insert into \w+ (?:\([^)]*\) )?values\b", re.I)
#: Code files with so large a share of lines that hold nothing but literals are stored data.
DATA_LINES = 0.85
_SUMS = (
    "chars lines blank compressed compressed_in token_bits tokens char_bits idents ident_chars short_idents camel digits symbols comment_chars code_lines "
    "long_lines literal_lines shapes numbers strings string_chars keywords spaces"
).split()
_KEYWORDS = frozenset("if else for while return def func function class try except catch raise throw import const let var new switch case assert yield with await async range".split())
_FEATURES = (
    "ratio token_entropy char_entropy ident_length short_share camel_share digit_share symbol_share comment_share mean_line longest long_share shape_share number_share string_share "
    "keyword_share space_share blank_share idents_per_line"
).split()


def _entropy_bits(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(c * math.log2(c / n) for c in counts.values()) if n else 0.0


def notices(text: str, start_line: int, project: str) -> tuple[bool, bool, bool]:
    """(notice of a tool, notice of a foreign origin, notice of the own project) in the comments at the file's top."""
    own_name = re.sub(r"\.git$", "", project.rstrip("/")).split("/")[-1].lower()
    tool = foreign = own = False
    room = max(HEADER_LINES - start_line + 1, PIECE_LINES)
    if not text:
        return False, False, False
    if "sourceMappingURL" in text and _MAPPED.search(text):
        tool = True
    inside, quoted, leading = False, False, True
    for number, line in enumerate(text.split("\n")):
        # past the first lines only what still belongs to a comment from there: an open one, or comment lines without code between
        # (where a piece begins within a file, a lone triple quote may as well close a text as open one)
        if number >= room and not (inside and (start_line <= 1 or not quoted) or leading):
            break
        begun = inside
        comment = inside or bool(_COMMENT.match(line))
        if line.count('"""') % 2 or line.count("'''") % 2:
            inside = quoted = not inside
        elif "/*" in line:
            comment, inside = comment or line.lstrip().startswith("/*"), "*/" not in line.split("/*")[-1]
        elif "*/" in line:
            inside = False
        leading = leading and (comment and (begun or not _NO_HEADER.match(line)) or not line.strip())
        if not comment or number >= room and not (begun or leading):
            continue
        if (begun or line.lstrip().startswith("/*")) and "*/" in line:
            line = line[: line.index("*/")]  # code may follow the comment
        if _BUILT.search(line):
            tool = True
        if _TOOL.search(line):
            tool = True
        for m in _ORIGIN.finditer(re.sub(r"^\s*(?://+!?|#+|/\*+!?|\*+|--|;+|<!--|- )\s*", "", line)):
            name = next((g for g in m.groups() if g), "").lower().rstrip(".,")
            if name and (name == own_name or name in ("this", "the", "a", "own")):
                own = True
            elif not re.search(r"(?i)copyright", m[0]) or not name or not _same_family(name, own_name):
                foreign = True
            else:
                own = True
    return tool, foreign, own


def _same_family(name: str, own: str) -> bool:
    """Names that differ in a trailing number only are the same project."""
    return re.sub(r"[-_]?\d+$", "", name) == re.sub(r"[-_]?\d+$", "", own)


def measure(text: str) -> dict[str, float]:
    """Sums of one piece. Comment lines that hold a notice are left out."""
    text = text.replace("\r\n", "\n")
    lines = (_MAPPED.sub("", text) if "sourceMappingURL" in text else text).split("\n")
    kept = [x for x in lines if not (_COMMENT.match(x) and (_TOOL.search(x) or _ORIGIN.search(x) or re.search(r"(?i)copyright|licen[sc]e", x)))]
    text = _BLOCK.sub(lambda m: "" if re.search(r"(?i)built \d|licen[sc]e|copyright|upstream|copied from|part of", m[0]) else m[0], "\n".join(kept))
    lines = text.split("\n")
    solid = [x for x in lines if x.strip()]
    comments = [x for x in solid if _COMMENT.match(x)]
    data = text.encode("utf-8", "replace")
    tokens = _TOKEN.findall(text)
    counts, chars = Counter(tokens), Counter(text)
    idents = [t for t in tokens if t[0].isalpha() or t[0] in "_$"]
    strings = re.findall(r"\"[^\"\n]*\"|'[^'\n]*'", text)
    return {
        "chars": len(text), "lines": len(solid), "blank": len(lines) - len(solid), "compressed": len(zlib.compress(data, 1)) if data else 0, "compressed_in": len(data),
        "token_bits": _entropy_bits(counts), "tokens": len(tokens), "char_bits": _entropy_bits(chars), "idents": len(idents), "ident_chars": sum(map(len, idents)),
        "short_idents": sum(len(t) <= 2 for t in idents), "camel": sum(not t.islower() for t in idents), "digits": sum(n for c, n in chars.items() if c.isdigit()),
        "symbols": sum(n for c, n in chars.items() if not c.isalnum() and not c.isspace()), "comment_chars": sum(map(len, comments)), "code_lines": len(solid) - len(comments),
        "long_lines": sum(len(x) for x in solid if len(x) > 160), "literal_lines": sum(bool(_LITERALS.match(x)) for x in solid), "shapes": len({_SHAPE.sub("w", x.strip()) for x in solid}), "numbers": sum(t[0].isdigit() for t in tokens),
        "strings": len(strings), "string_chars": sum(map(len, strings)), "keywords": sum(n for t, n in counts.items() if t in _KEYWORDS), "spaces": chars.get(" ", 0) + chars.get("\t", 0),
    }


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["project_id", "ref", "path", "tool", "foreign", "own", "longest", *_SUMS]
    for pdf in batches:
        rows = []
        for project, ref, path, line, text in zip(*(pdf[c].tolist() for c in ("project_id", "ref", "path", "start_line", "text"))):
            text = text or ""
            tool, foreign, own = notices(text, int(line), project or "")
            sums = measure(text)
            rows.append((project, ref, path, tool, foreign, own, max(map(len, text.split("\n"))), *(float(sums[k]) for k in _SUMS)))
        yield pd.DataFrame(rows, columns=columns)


def features(chunks: DataFrame) -> DataFrame:
    """One row per file: flags of its notices and its features. Repeated rows weigh double and change no share."""
    wanted = chunks.where(F.col("path").isNotNull()).select("project_id", "ref", "path", F.coalesce(F.col("start_line"), F.lit(1)).cast("int").alias("start_line"), "text")
    schema = "project_id string, ref string, path string, tool boolean, foreign boolean, own boolean, longest long, " + ", ".join(f"{k} double" for k in _SUMS)
    per = wanted.mapInPandas(_pieces, schema)
    # the sums are additive, so a file of any number of pieces is reduced map-side
    files = per.groupBy("project_id", "ref", "path").agg(
        *(F.max(k).alias(k) for k in ("tool", "foreign", "own", "longest")), *(F.sum(k).alias(k) for k in _SUMS)
    )

    def share(a: str, b: str):
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    return files.select(
        "project_id", "ref", "path", "tool", "foreign", "own",
        share("compressed", "compressed_in").alias("ratio"), share("token_bits", "tokens").alias("token_entropy"), share("char_bits", "chars").alias("char_entropy"),
        share("ident_chars", "idents").alias("ident_length"), share("short_idents", "idents").alias("short_share"), share("camel", "idents").alias("camel_share"),
        share("digits", "chars").alias("digit_share"), share("symbols", "chars").alias("symbol_share"), share("comment_chars", "chars").alias("comment_share"),
        share("chars", "lines").alias("mean_line"), F.col("longest").cast("double").alias("longest"), share("long_lines", "chars").alias("long_share"), ((share("literal_lines", "lines") >= DATA_LINES) & (F.col("lines") >= 8)).alias("data"),
        share("shapes", "lines").alias("shape_share"), share("numbers", "tokens").alias("number_share"), share("string_chars", "chars").alias("string_share"),
        share("keywords", "tokens").alias("keyword_share"), share("spaces", "chars").alias("space_share"), share("blank", "lines").alias("blank_share"), share("idents", "lines").alias("idents_per_line"),
    )


def judged(chunks: DataFrame, stage, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """Every file with its notices, place, chance by the forest and the verdict: project_id, ref, path, tool, foreign, own, placed, data, chance, found.

    chunks: project_id, ref, path, start_line, text. A NULL start line counts as 1, a NULL or empty text has no features;
    rows with a NULL path are no files. Where no label of one class occurs (an empty or tiny table), the forest is left
    out and chance is 0. The forest is fitted on at most ``sample`` labelled files of either class, drawn by hash.
    """
    files = stage(features(chunks), "file-features")
    path = F.col("path")
    placed = path.rlike(f"(?i){_PLACE.pattern}")
    named = path.rlike(f"(?i){_NAME.pattern}") | path.rlike(f"(?i){_TOOL_PLACE.pattern}")
    data = F.col("data") & ~path.rlike(f"(?i){_PROSE.pattern}")
    label = F.when(F.col("tool") & ~F.col("foreign"), 1.0).when(F.col("own") & ~F.col("foreign"), 0.0)  # header notices alone
    labelled = files.select(*_FEATURES, label.alias("label"), F.xxhash64("project_id", "ref", "path").alias("h")).where(F.col("label").isNotNull())
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assembler = VectorAssembler(inputCols=_FEATURES, outputCol="features", handleInvalid="keep")
    if counts.get(0.0) and counts.get(1.0):
        room = [F.least(F.lit(1.0), F.lit(sample / counts[k])) for k in (0.0, 1.0)]
        drawn = labelled.where(F.pmod("h", F.lit(1 << 20)) < F.when(F.col("label") == 0.0, room[0]).otherwise(room[1]) * (1 << 20))
        train = assembler.transform(drawn.orderBy("h").coalesce(1)).select("features", "label").persist()
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="sqrt", minInstancesPerNode=2)
        model = forest.fit(train)
        train.unpersist()
        scored = model.transform(assembler.transform(files)).withColumn("chance", vector_to_array("probability")[1])
    else:
        scored = files.withColumn("chance", F.lit(0.0))
    return scored.select(
        "project_id", "ref", "path", "tool", "foreign", "own", (placed | named).alias("placed"), data.alias("data"), "chance",
        (F.col("tool") | F.col("foreign") | placed | named | data | (F.col("chance") >= CHANCE)).alias("found"),
    )
