"""Chunkers: sliding window in the JVM, prose and code by line in Python, and their dispatch by extension."""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.arrays import sums_before
from tessera.spec import CHUNK_SIZE, MIN_TOKENS, OVERLAP

# Extensions (case matters).
PROSE = "md markdown txt text rst adoc org wiki".split()
CODE = {
    "rust": ["rs"], "python": ["py", "pyi"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx"], "go": ["go"], "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hpp", "hxx", "hh"], "java": ["java"], "csharp": ["cs"],
}
LANGUAGE = {e: lang for lang, ends in CODE.items() for e in ends}

CHUNK_COLUMNS = "file_path string, byte_offset bigint, line_number int, text string, token_count int"
_B = r" \t\n\f\r"


def window_shape(size: int, overlap: float) -> tuple[int, int]:
    """Stride in tokens, and how many strides one window spans."""
    if size < 1:
        raise ValueError("size must be positive")
    stride = max(size - math.floor(size * min(max(overlap, 0.0), 0.9)), 1)
    return stride, math.ceil(size / stride)


def sliding_window(files: DataFrame, size: int = CHUNK_SIZE, overlap: float = OVERLAP) -> DataFrame:
    """Windows of size tokens (runs of characters other than ASCII blanks), each stride after the one before.

    files has path, content and any other columns, which pass through; out come ordinal, byte_offset, line_number, text
    (the slice of the content) and token_count. Null, empty and blank contents give none. The text is cut once into
    strides; a window is the first tokens of the strides that it spans, so the work is linear in the text.
    """
    stride, span = window_shape(size, overlap)
    others = [c for c in files.columns if c not in ("content", "ordinal", "byte_offset", "line_number", "text", "token_count")]
    cores = F.regexp_extract_all("content", F.lit(rf"(?:[^{_B}]++[{_B}]*+){{1,{stride}}}+"), F.lit(0))
    lead = F.regexp_extract("content", rf"^[{_B}]*+", 0)
    df = files.select(*others, cores.alias("__c"), F.octet_length(lead).alias("__lead"), F.regexp_count(lead, F.lit("\n")).alias("__lines")).where(F.size("__c") > 0)
    texts = F.transform(
        "__c", lambda c, i: F.rtrim(F.regexp_extract(F.array_join(F.slice("__c", i + 1, F.lit(span)), ""), rf"^(?:[^{_B}]++[{_B}]*+){{1,{size}}}+", 0), F.lit(T.ASCII_BLANKS))
    )
    bytes_before = sums_before(F.transform("__c", lambda c: F.octet_length(c)))
    lines_before = sums_before(F.transform("__c", lambda c: F.regexp_count(c, F.lit("\n"))))
    windows = F.arrays_zip(texts.alias("text"), bytes_before.alias("bytes"), lines_before.alias("lines"))
    df = df.select(*others, "__lead", "__lines", F.posexplode(windows).alias("ordinal", "__w"))
    return df.select(
        *others,
        "ordinal",
        (F.col("__lead") + F.col("__w.bytes")).cast("bigint").alias("byte_offset"),
        (F.col("__lines") + F.col("__w.lines") + 1).cast("int").alias("line_number"),
        F.col("__w.text").alias("text"),
    ).withColumn("token_count", F.regexp_count("text", F.lit(rf"[^{_B}]+")))


def _lines(content: str) -> list[str]:
    lines = content.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def _n(text: str) -> int:
    return len(text.split())


def prose_rows(content: str, least: int = MIN_TOKENS, most: int = CHUNK_SIZE, exact_offsets: bool = False) -> list[tuple[int, int, str, int]]:
    """(byte_offset, line_number, text, token_count) of paragraphs; a heading or blank line closes one that has enough
    tokens, shorter ones grow on. The place is the first occurrence of the first line anywhere, unless exact_offsets."""
    rows: list[list] = []
    buf: list[str] = []
    place = (0, 1)
    at = 0
    starts = []
    for raw in content.split("\n"):
        starts.append(at)
        at += len(raw) + 1
    tokens = 0
    for i, line in enumerate(_lines(content)):
        blank = not line.strip()
        if (line.startswith("#") or blank) and tokens >= least:
            rows.append([*place, "\n".join(buf).strip(), tokens])
            buf, tokens = [], 0
        if blank and not buf:
            continue
        if not buf:
            pos = starts[i] if exact_offsets else content.find(line)
            place = (len(content[:pos].encode()), content.count("\n", 0, pos) + 1)
        buf.append(line)
        tokens += _n(line)
        if tokens >= most:
            rows.append([*place, "\n".join(buf).strip(), tokens])
            buf, tokens = [], 0
    rest = "\n".join(buf).strip()
    if rest:
        if tokens >= least or not rows:
            rows.append([*place, rest, tokens])
        else:
            rows[-1][2] += "\n" + rest
            rows[-1][3] += tokens
    return [tuple(r) for r in rows]


# What begins a definition at the start of a statement, by language: the node kinds of the usual grammars. What stands
# before such a node and is none of it (template heads, typedef, storage classes before a struct) is skipped.
_HEADS = {
    "rust": r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:async\s+|unsafe\s+|const\s+|extern\s+\"[^\"]*\"\s+)*(?:fn|impl|struct|enum|trait|mod)\b|macro_rules!",
    "javascript": r"export\b|(?:async\s+)?function\b(?!\s*\*)|class\b",
    "typescript": r"export\b|(?:async\s+)?function\b(?!\s*\*)|class\b|interface\s+\w|(?:const\s+)?enum\s+\w",
    "go": r"func\b|type\b",
    "c": r"struct\b\s*\w*\s*\{|(?!(?:if|for|while|switch|return|else|do|typedef|using|extern\s+\")\b)[A-Za-z_][\w\s*]*?[\s*]\w+\s*\([^;{}]*\)\s*\{",
    "cpp": r"(?:struct|class)\b\s*\w*[^;{()=]*\{|namespace\b[^;{=]*\{|(?!(?:if|for|while|switch|return|else|do|typedef|using|template|extern\s+\")\b)[A-Za-z_~][\w\s*&:<>,~]*?[\s*&:]~?\w+\s*\([^;{}]*\)[^;{}]*\{",
    "java": r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum|record)\b",
    "csharp": r"(?:\[[^\]]*\]\s*)*(?:(?:public|protected|private|internal|static|sealed|abstract|partial|readonly|ref|unsafe)\s+)*(?:namespace|class|interface|enum|record|struct)\b",
}
_BEFORE = {"cpp": re.compile(r"template\s*(?=<)|(?:typedef|static|const|extern|inline|constexpr|volatile)\s+"), "c": re.compile(r"(?:typedef|static|const|extern|inline|volatile)\s+")}
_MARKS = re.compile(r"[{}()\[\];\n]")
_HEAD_RE = {k: re.compile(v) for k, v in _HEADS.items()}
_MASKED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'", re.DOTALL)
_SCRIPT_MASKED = re.compile(_MASKED.pattern + r"|(?<=[=(,:\[!&|?{};\n ])/(?![*/ =])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*(?=\s*[),;.\]}\n])", re.DOTALL)
_RUST_MASKED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r#*\".*?\"#*|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.DOTALL)
_SCRIPTS = ("javascript", "typescript")


def _definitions(content: str, lang: str) -> list[tuple[int, int]]:
    """Spans of the outermost definitions."""
    if lang == "python":
        return _python_definitions(content)
    pattern = _RUST_MASKED if lang == "rust" else _SCRIPT_MASKED if lang in _SCRIPTS else _MASKED
    masked = pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), content)
    if lang in _SCRIPTS:
        return _script_definitions(masked, lang)
    head, before = _HEAD_RE[lang], _BEFORE.get(lang)
    spans: list[tuple[int, int]] = []
    at, n = 0, len(masked)
    fresh = True
    while at < n:
        c = masked[at]
        if c.isspace():
            at += 1
            continue
        if fresh:
            m = head.match(masked, at)
            if m:
                end = _end(masked, at, lang)
                if not _signature(masked, at, end, lang):
                    spans.append((at, end))
                at = end
                continue
            if before and (m := before.match(masked, at)):
                at = _angles(masked, m.end()) if m.group(0).startswith("template") else m.end()
                continue
            if c in "#@" and lang not in ("java", "csharp"):  # attributes, preprocessor lines
                stop = masked.find("\n", at)
                at = n if stop < 0 else stop + 1
                continue
        fresh = c in "{};"
        if c.isalnum() or c == "_":
            while at < n and (masked[at].isalnum() or masked[at] == "_"):
                at += 1
        else:
            at += 1
        if c == "]" or at < n and masked[at] == "\n" and lang in ("go", "rust", "c", "cpp"):
            fresh = True
    return spans


_SIGNATURES = {"rust": re.compile(r"[^;{]*?\bfn\b[^{]*;"), "typescript": re.compile(r"(?:async\s+)?function\b[^{]*;")}


def _signature(masked: str, at: int, end: int, lang: str) -> bool:
    """A function without a body is no definition."""
    return lang in _SIGNATURES and _SIGNATURES[lang].fullmatch(masked, at, end) is not None


def _angles(masked: str, at: int) -> int:
    """Behind the angle brackets that open at at."""
    depth = 0
    for m in re.compile(r"[<>;{]").finditer(masked, at):
        c = m.group(0)
        depth += (c == "<") - (c == ">")
        if c in ";{" or depth == 0:
            return m.end() if c == ">" else m.start()
    return len(masked)


_ARROW_ONE = re.compile(r"(?:async\s+)?[A-Za-z_$][\w$]*\s*=>")
_ARROW_MANY = re.compile(r"(?:async\s*)?(?:<[^<>()]*>\s*)?(?=\()")
_TO_ARROW = re.compile(r"\s*(?::\s*[^=;{}]*?)?=>")
_METHOD = re.compile(r"(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*|\[[^\]\n]*\])\s*(?:<[^<>()]*>\s*)?(?=\()")
_METHOD_BODY = re.compile(r"\s*(?::\s*[^;{}=]+)?(?=\{)")
_NO_METHOD = frozenset("if for while switch catch with function return await typeof new super import else do try".split())
_ANNOTATED = re.compile(r"(?:const|let|var)\s+[\w$]+\s*:\s*$")
_TYPE_ALIAS = re.compile(r"(?:declare\s+)?type\s+[\w$]+[^=;\n]*=")


def _script_definitions(masked: str, lang: str) -> list[tuple[int, int]]:
    """Declarations at the start of statements, and wherever they stand outside of others, functions with an arrow and
    methods of object literals, class expressions and abstract classes."""
    head = _HEAD_RE[lang]
    close: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[(){}\[\]]", masked):
        if m.group(0) in "({[":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    spans: list[tuple[int, int]] = []
    n, at, last = len(masked), 0, ";"  # last is the sign before, a line feed between them counting as an end
    while at < n:
        c = masked[at]
        if c.isspace():
            if c == "\n" and last not in "=(,:?&|+-*/<>.[!~^%":
                last = ";"
            at += 1
            continue
        fresh = last in ";{}"
        if fresh and (m := head.match(masked, at)):
            end = _end(masked, at, lang)
            if not _signature(masked, at, end, lang):
                spans.append((at, end))
            at, last = end, "}"
            continue
        if fresh and lang == "typescript" and (m := _TYPE_ALIAS.match(masked, at)):
            at, last = _expression_end(masked, m.end(), close), ";"
            continue
        if fresh and lang == "typescript" and masked.startswith("declare ", at):
            at += 8
            continue
        word = c.isalnum() or c in "_$#"
        if word or c in "(<[*":
            end = None
            if c in "(<" or masked.startswith("async", at):
                m = _ARROW_MANY.match(masked, at)
                if m and (b := close.get(m.end())) and (x := _TO_ARROW.match(masked, b + 1)) and not (last == ":" and _ANNOTATED.search(masked[max(0, at - 80) : at])):
                    end = _arrow_end(masked, x.end(), close)
            if end is None and word and (m := _ARROW_ONE.match(masked, at)):
                end = _arrow_end(masked, m.end(), close)
            if end is None and last in ";{},":
                m = _METHOD.match(masked, at)
                if m and m.group(1) not in _NO_METHOD and (b := close.get(m.end())) and (x := _METHOD_BODY.match(masked, b + 1)) and (e := close.get(x.end())):
                    end = e + 1
            if end is not None:
                spans.append((at, end))
                at, last = end, "x"
                continue
        if word:
            while at < n and (masked[at].isalnum() or masked[at] in "_$#"):
                at += 1
            last = "x"
        else:
            at += 1
            last = c
    return spans


def _arrow_end(masked: str, at: int, close: dict[int, int]) -> int:
    while at < len(masked) and masked[at].isspace():
        at += 1
    return close[at] + 1 if masked[at : at + 1] == "{" and at in close else _expression_end(masked, at, close)


def _expression_end(masked: str, at: int, close: dict[int, int]) -> int:
    """Where the expression that begins at at ends: before a comma, semicolon or bracket of what is around, or at the
    end of a line after which it does not go on."""
    n, end = len(masked), at
    while at < n:
        c = masked[at]
        if c in ",;)]}":
            break
        if c == "\n" and masked[end - 1 : end] not in ("=", "(", ",", "?", ":", "&", "|", "+", "-", "*", "/", "<", ">", ".", "["):
            m = re.compile(r"\s*").match(masked, at)
            if masked[m.end() : m.end() + 1] not in ".?:+-*/&|=<>":
                break
        if c in "({[" and at in close:
            at = close[at]
        at += 1
        if not masked[at - 1].isspace():
            end = at
    return end


def _end(masked: str, at: int, lang: str) -> int:
    """End of the definition that begins at at: its last brace, or the semicolon (line end in Go) before any."""
    depth = 0
    for m in _MARKS.finditer(masked, at):
        i, c = m.start(), m.group(0)
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth < 0:
                return i
            if depth == 0 and (c == "}" or c == ")" and lang == "go" and re.match(r"type\s*\(", masked[at:i])):
                follows = re.match(r"\s*(?:from\b[^\n;]*)?;", masked[i + 1 :]) if lang in ("javascript", "typescript") and masked.startswith("export", at) else None
                return i + 1 + (follows.end() if follows else 0)
        elif c == ";" and depth == 0:
            return i + 1
        elif c == "\n" and depth == 0 and lang == "go" and masked[at:i].strip() and not masked[at:i].rstrip().endswith((",", "(", "{")):
            return i
    return len(masked.rstrip())


def _python_definitions(content: str) -> list[tuple[int, int]]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        starts = [m.start() for m in re.finditer(r"(?m)^(?:async\s+def|def|class)\b", content)]
        spans = []
        for s in starts:
            m = re.compile(r"\n(?=[^\s#)\]}])").search(content, s)
            spans.append((s, s + len(content[s : m.start() if m else len(content)].rstrip())))
        return spans
    lines = [0]
    for raw in content.encode().split(b"\n"):
        lines.append(lines[-1] + len(raw) + 1)
    data = content.encode()
    place = lambda line, col: len(data[: lines[line - 1] + col].decode(errors="ignore"))
    found: list[tuple[int, int]] = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                found.append((place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)))
            else:
                visit(child)

    visit(tree)
    return found


_EXPORTED = re.compile(r"export\s+(?:default\s+)?(?=(?:async\s+)?function\b(?!\s*\*)|class\b|interface\s|(?:const\s+)?enum\s)")


def code_rows(path: str, content: str, least: int = MIN_TOKENS, most: int = CHUNK_SIZE) -> list[tuple[int, int, str, int]]:
    """One row per outermost definition of at least least tokens, prefixed with "[path] "; larger ones than most by
    blocks between blank lines, short blocks dropped. A file without any is one row without prefix. Unknown languages
    give none. The definitions come from a scanner (the ast module for Python), not from a full grammar."""
    lang = LANGUAGE.get(path.rsplit(".", 1)[-1]) if "." in path else None
    if lang is None:
        return []
    prefix = f"[{path}] "
    rows = []
    for s, e in _definitions(content, lang):
        text = content[s:e]
        count = _n(text)
        offset, line = len(content[:s].encode()), content.count("\n", 0, s) + 1
        if count < least:
            continue
        if count <= most:
            rows.append((offset, line, prefix + text, _n(prefix + text)))
            continue
        if lang in _SCRIPTS and (inner := _EXPORTED.match(text)):  # the declaration that is exported, if it is one
            s += inner.end()
            text, offset = text[inner.end() :], offset + len(text[: inner.end()].encode())
            line = content.count("\n", 0, s) + 1
            if _n(text) <= most:
                rows.append((offset, line, prefix + text, _n(prefix + text)))
                continue
        block = ""
        first = 0
        for i, x in enumerate([*_lines(text), ""]):
            if not x.strip() and block.strip():
                if _n(block) >= least:
                    rows.append((offset, line + first, prefix + block, _n(prefix + block)))
                block = ""
            else:  # blank lines before a block belong to it
                first = i if not block else first
                block += x + "\n"
    if not rows and content.strip():
        rows.append((0, 1, content, _n(content)))
    return rows


#: Characters of chunk text that are sent on at once.
_FLUSH = 4_000_000


def _chunk_batches(batches: Iterator[pa.RecordBatch], kind: str, least: int, most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        source: list[int] = []
        found: list[tuple] = []
        size = 0
        for i in range(b.num_rows):
            path, content = b.column(b.num_columns - 2)[i].as_py(), b.column(b.num_columns - 1)[i].as_py()
            rows = prose_rows(content or "", least, most) if kind == "prose" else code_rows(path or "", content or "", least, most)
            source += [i] * len(rows)
            found += [(n, *r) for n, r in enumerate(rows)]
            size += sum(len(r[2]) for r in rows)
            if size > _FLUSH or i == b.num_rows - 1 and found:
                take = pa.array(source, pa.int32())
                n, off, line, text, count = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(take) for c in b.columns[:-2]), pa.array(n, pa.int32()), pa.array(off, pa.int64()), pa.array(line, pa.int32()), pa.array(text, pa.string()), pa.array(count, pa.int32())],
                    [*b.schema.names[:-2], "ordinal", "byte_offset", "line_number", "text", "token_count"],
                )
                source, found, size = [], [], 0


def _by_line(files: DataFrame, kind: str, least: int, most: int) -> DataFrame:
    others = [c for c in files.columns if c not in ("content", "ordinal", "byte_offset", "line_number", "text", "token_count")]
    df = files.select(*others, F.col("path").alias("__path"), "content")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-2])
    return df.mapInArrow(lambda it: _chunk_batches(it, kind, least, most), f"{kept}, ordinal int, byte_offset bigint, line_number int, text string, token_count int")


def prose_chunks(files: DataFrame, least: int = MIN_TOKENS, most: int = CHUNK_SIZE) -> DataFrame:
    return _by_line(files, "prose", least, most)


def code_chunks(files: DataFrame, least: int = MIN_TOKENS, most: int = CHUNK_SIZE) -> DataFrame:
    return _by_line(files, "code", least, most)


def chunk_files(files: DataFrame, size: int = CHUNK_SIZE, overlap: float = OVERLAP) -> DataFrame:
    """Each file by the chunker of its extension: code, prose, else sliding window. All columns but content pass through;
    out come ordinal, byte_offset, line_number, text, token_count."""
    ext = T.extension(F.col("path"))
    code, prose = ext.isin(*LANGUAGE), ext.isin(*PROSE)
    columns = [c for c in files.columns if c != "content"] + ["ordinal", "byte_offset", "line_number", "text", "token_count"]
    parts = [code_chunks(files.where(code), MIN_TOKENS, size), prose_chunks(files.where(prose), MIN_TOKENS, size), sliding_window(files.where(~code & ~prose), size, overlap)]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out
