"""Cutting source files into chunks: line windows in plain SQL, syntax chunks as a table function."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions import text as T

CHUNKS = "project_id string, ref string, path string, start_line int, end_line int, symbol string, text string"
#: A parser takes a text and returns its top-level nodes as (start, end, symbol, is definition) in characters.
Parser = Callable[[str], list[tuple[int, int, str, bool]]]


def line_windows(files: DataFrame, window: int = 120) -> DataFrame:
    """Consecutive windows of ``window`` lines; windows of blank lines only are left out. Map-only, inside the JVM.

    files: any columns and ``text``. Adds start_line, end_line (1-based, inclusive), symbol ('') and the window's text.
    NULL and empty texts give no rows.
    """
    cut = files.where(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("_lines", T.lines(F.col("text")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_lines") - 1, F.lit(0)), F.lit(window))
    windows = cut.withColumn("_start", F.explode(starts)).withColumn("_block", F.slice("_lines", F.col("_start") + 1, window))
    return (
        windows.where(F.exists("_block", lambda x: ~T.is_blank(x)))
        .withColumn("start_line", F.col("_start") + 1)
        .withColumn("end_line", F.col("_start") + F.size("_block"))
        .withColumn("symbol", F.lit(""))
        .withColumn("text", F.array_join("_block", "\n"))
        .drop("_lines", "_start", "_block")
    )


def python_nodes(text: str) -> list[tuple[int, int, str, bool]]:
    """Top-level statements of a Python text. A decorated definition counts as no definition, like other wrapped nodes."""
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    lines = text.split("\n")

    def at(line: int, column: int) -> int:  # ast counts columns in UTF-8 bytes
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))

    out = []
    for node in ast.parse(text).body:
        decorators = getattr(node, "decorator_list", [])
        first = min([node.lineno, *(d.lineno for d in decorators)])
        start = at(node.lineno, node.col_offset) if not decorators else starts[first - 1] + len(lines[first - 1]) - len(lines[first - 1].lstrip())
        definition = isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and not decorators
        out.append((start, at(node.end_lineno, node.end_col_offset), node.name if definition else "", definition))
    return out


def _dense(text: str) -> int:
    return len("".join(text.split()))


def pack_nodes(text: str, nodes: list[tuple[int, int, str, bool]], budget: int) -> list[tuple[int, int, str]]:
    """Spans (start, end, symbol): definitions alone, runs of other nodes together while they fit the budget."""
    spans: list[tuple[int, int, str]] = []
    open_run = False
    for start, end, symbol, definition in nodes:
        if not text[start:end].strip():
            continue
        if not definition and open_run and _dense(text[spans[-1][0] : end]) <= budget:
            spans[-1] = (spans[-1][0], end, "")
        else:
            spans.append((start, end, symbol))
        open_run = not definition
    return spans


def split_span(text: str, first_line: int, symbol: str, budget: int) -> Iterator[tuple[int, int, str, str]]:
    """(start line, end line, symbol, text): lines gathered until they reach the budget; the symbol stays with the first."""
    begin, size = 0, 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        size += _dense(line)
        last = k == len(lines) - 1
        piece = lines[begin : k + 1]
        if size >= budget or last and any(x.strip() for x in piece):
            yield first_line + begin, first_line + k, symbol if begin == 0 else "", "\n".join(piece)
            begin, size = k + 1, 0


def syntax_chunks(text: str, parser: Parser, budget: int) -> list[tuple[int, int, str, str]]:
    """Chunks of one text by its syntax: (start line, end line, symbol, text)."""
    out = []
    for start, end, symbol in pack_nodes(text, parser(text), budget):
        part, line = text[start:end], text.count("\n", 0, start) + 1
        if _dense(part) <= budget:
            out.append((line, text.count("\n", 0, max(start, end - 1)) + 1, symbol, part))
        else:
            out += split_span(part, line, symbol, budget)
    return out


def window_rows(text: str, window: int) -> list[tuple[int, int, str, str]]:
    """Line windows of one text, the fall-back of :func:`chunk_files`."""
    lines = text.splitlines()
    blocks = ((k, lines[k : k + window]) for k in range(0, len(lines), window))
    return [(k + 1, k + len(b), "", "\n".join(b)) for k, b in blocks if any(x.strip() for x in b)]


def _grammar(language: str) -> Parser | None:
    """A grammar-based parser, where the optional package is installed."""
    try:
        from tree_sitter_languages import get_parser
    except ImportError:
        return None
    # fixed values: node types that are definitions, and the types of their names
    definitions = {
        "function_definition", "function_declaration", "method_definition", "method_declaration", "class_definition", "class_declaration",
        "function_item", "impl_item", "struct_item", "constructor_declaration", "interface_declaration", "trait_item",
    }
    names = ("identifier", "name", "field_identifier", "type_identifier")
    parser = get_parser(language)

    def nodes(text: str) -> list[tuple[int, int, str, bool]]:
        data = text.encode()

        def char(offset: int) -> int:
            return len(data[:offset].decode("utf-8", "replace"))

        out = []
        for n in parser.parse(data).root_node.children:
            is_def = n.type in definitions
            name = next((data[c.start_byte : c.end_byte].decode("utf-8", "replace") for c in n.children if c.type in names), "") if is_def else ""
            out.append((char(n.start_byte), char(n.end_byte), name, is_def))
        return out

    return nodes


# fixed values: languages by file suffix
LANGUAGES = {
    ".py": "python", ".go": "go", ".java": "java", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".rb": "ruby", ".rs": "rust",
    ".cs": "c_sharp", ".kt": "kotlin", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".h": "cpp", ".hpp": "cpp", ".php": "php", ".scala": "scala",
}


def parser_for(path: str) -> Parser | None:
    name = path.rsplit("/", 1)[-1]
    language = LANGUAGES.get("." + name.rsplit(".", 1)[1] if "." in name else "")
    if language is None:
        return None
    return _grammar(language) or (python_nodes if language == "python" else None)


def chunk_files(files: DataFrame, budget: int = 1_500, window: int = 120) -> DataFrame:
    """Chunks of files by syntax where a parser is at hand, else by line windows; failures become rows with ``error``.

    files: project_id, ref, path, text. Result: the chunk columns and error (NULL for chunks). Map-only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNKS.split(", ")] + ["error"]
        for pdf in batches:
            rows = []
            for project, ref, path, text in zip(*(pdf[c].tolist() for c in ("project_id", "ref", "path", "text"))):
                try:
                    if not isinstance(text, str):
                        raise TypeError("no text")
                    parser, cut = parser_for(path or ""), []
                    if parser:
                        try:
                            cut = syntax_chunks(text, parser, budget)
                        except (SyntaxError, ValueError, RecursionError):
                            cut = []
                    rows += [(project, ref, path, *c, None) for c in cut or window_rows(text, window)]
                except Exception as problem:  # one bad file must not end the job
                    rows.append((project, ref, path, None, None, None, None, f"{path}: {problem}"))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"start_line": "Int32", "end_line": "Int32", **{c: object for c in ("symbol", "text", "error")}})

    return files.select("project_id", "ref", "path", "text").mapInPandas(run, CHUNKS + ", error string")
