"""Scalar functions as Column expressions: all stay in the JVM and in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.language import Content, java_regex

LANGUAGES = {
    "c": "c", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "go": "go", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "java": "java", "kt": "jvm", "kts": "jvm", "scala": "jvm",
    "lua": "lua", "nix": "nix", "m": "objc", "mm": "objc", "php": "php", "proto": "proto", "py": "python", "rs": "rust", "swift": "swift", "ts": "ts", "tsx": "ts", "glsl": "glsl", "vert": "glsl", "frag": "glsl",
}


def line_count(text: Column) -> Column:
    """Lines of a text; a last newline begins no line; an empty text has none."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def contains_plain(text: Column, term: str, sensitive: bool) -> Column:
    return F.contains(text, F.lit(term)) if sensitive else F.contains(F.lower(text), F.lit(term.lower()))


def content_predicate(text: Column, term: Content, sensitive: bool) -> Column:
    if not term.regex:
        return contains_plain(text, term.text, sensitive)
    return text.rlike(java_regex(term.text, sensitive))


def path_matches(path: Column, like: str) -> Column:
    """Whole-path glob (already a LIKE pattern with backslash escapes), in any letter case."""
    return path.ilike(like)


def skipped_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("target", "node_modules", ".git"))))


def normalized_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(path), "/+", "/"), "^/|/$", "")


def relative_path(path: Column, root: str) -> Column:
    """The part of a path under root with forward slashes; null outside of root."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(unified, F.lit(base)), F.substring(unified, len(base) + 1, 1 << 30))


def directory(path: Column) -> Column:
    """The directory facet: everything before the last slash and /*."""
    return F.when(F.contains(path, F.lit("/")), F.concat(F.regexp_replace(path, "/[^/]+$", ""), F.lit("/*"))).otherwise("/*")


def parent_directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_facet(path: Column) -> Column:
    """Lower case after the last dot of the path, which may stand in a directory; none: no_ext."""
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(~F.contains(path, F.lit(".")) | (ext == ""), "no_ext").otherwise(ext)


def infer_language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    name = basename(path)
    return F.when(name.rlike(r".\.[^.]+$"), F.try_element_at(known, F.lower(F.substring_index(name, ".", -1))))


def namespace_from_path(path: Column, rust: bool = False) -> Column:
    """Path parts joined by ::, without src in front and without the extension. Rust: lib, main and mod name their parent,
    or crate at the top."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    parts = F.when(F.get(parts, F.lit(0)) == "src", F.slice(parts, 2, 1 << 20)).otherwise(parts)
    stem = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]*$", "")
    heads = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    full = F.array_join(F.concat(heads, F.array(stem)), "::")
    if rust:
        up = F.when(F.size(heads) == 0, "crate").otherwise(F.array_join(heads, "::"))
        full = F.when(stem.isin("lib", "mod"), up).otherwise(full)
    return F.when(F.size(parts) > 0, full).otherwise("")


def looks_like_symbol(name: Column) -> Column:
    """Up to 128 letters, digits and signs of qualified names, one of them a letter or an underscore."""
    return name.rlike(r"^(?=.*[A-Za-z_])[A-Za-z0-9_:.$#]{1,128}$")


def split_qualified(name: Column) -> tuple[Column, Column]:
    """(namespace or null, name) around the last ::."""
    has = F.contains(name, F.lit("::"))
    last = F.substring_index(name, "::", -1)
    head = F.substring(name, F.lit(1), F.length(name) - F.length(last) - 2)
    return F.when(has & (head != ""), head), F.when(has & (last != ""), last).otherwise(name)


def fully_qualified(namespace: Column, name: Column) -> Column:
    return F.when(namespace.isNull() | (namespace == ""), name).otherwise(F.concat(namespace, F.lit("::"), name))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{Alnum}\u0080-￿]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Trigrams in common by all of both."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) + F.size(y)) == 0, 0.0).otherwise(both / (F.size(x) + F.size(y) - both))


def _prefix(text: Column, prefix: Column) -> Column:
    return F.like(text, F.concat(prefix, F.lit("%")))


def symbol_weight(name: Column, qualified: Column, namespace: Column, kind: Column, path: Column, needle: str | None = None, wanted: str | None = None, path_hint: str | None = None) -> Column:
    """Relevance of a symbol: what it is, whether it is the name asked for, how near its namespace and path are."""
    total = F.when(kind == "definition", 200.0).when(kind == "declaration", 100.0).otherwise(50.0)
    if needle:
        total += F.when(name == needle, 40.0).otherwise(0.0) + F.when(qualified == needle, 35.0).otherwise(0.0)
    bare = namespace.isNull() | (namespace == "")
    if not wanted:
        total += F.when(bare, 70.0).otherwise(-15.0)
    else:
        w = F.lit(wanted)
        near = F.when(namespace == w, 95.0).when(_prefix(namespace, F.lit(wanted + "::")), 75.0).when(F.like(w, F.concat(namespace, F.lit("::%"))), 55.0).otherwise(-20.0)
        total += F.when(bare, -25.0).otherwise(near)
    if path_hint:
        h = F.lit(path_hint)
        total += F.when(path == h, 150.0).when(_prefix(path, h), 90.0).when(F.like(h, F.concat(path, F.lit("%"))), 70.0).otherwise(F.greatest(similarity(path, h) * 120 - 30, F.lit(-30.0)))
    return total


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def age_seconds(ts: Column, now: Column) -> Column:
    return F.greatest(F.unix_timestamp(now) - F.unix_timestamp(ts), F.lit(0))


def human_age(seconds: Column) -> Column:
    whole = lambda n: F.floor(seconds / n).cast("string")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(whole(60), F.lit("m"))).when(seconds < 86400, F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(86400), F.lit("d")))


def in_paths(path: Column, entries: list[str]) -> Column:
    """Whether a path is one of the entries, or under one that ends with a slash."""
    tests = [path.like(e + "%") if e.endswith("/") else path == e for e in entries]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def line_slice(text: Column, first: Column | int, last: Column | int) -> Column:
    """Lines first to last (from 1, both included) of a text, clamped to what there is."""
    lines = F.split(text, "\n", -1)
    a = F.greatest(F.lit(first) if isinstance(first, int) else first, F.lit(1))
    b = F.least(F.lit(last) if isinstance(last, int) else last, F.size(lines))
    return F.when(b >= a, F.array_join(F.slice(lines, a, F.greatest(b - a + 1, F.lit(0))), "\n")).otherwise("")


def permalink(repository: Column, commit: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit("/repo/"), repository, F.lit("/tree/"), commit, F.lit("/"), path, F.when(line.isNotNull(), F.concat(F.lit("#L"), line.cast("string"))).otherwise(""))
