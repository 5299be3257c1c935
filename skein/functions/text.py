"""Column functions on paths, entity names and module lists. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no label", compared lower-cased and trimmed.
UNLABELLED = ("", "nan", "none", "unmapped", "__none__")
#: Path tokens that carry no module information.
STOP_TOKENS = ("org", "apache", "src", "main", "java")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trimmed(c: Column) -> Column:
    """Without white space of any script at either end; SQL ``trim`` removes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tidy_path(c: Column) -> Column:
    """Trimmed, with forward slashes."""
    return trimmed(F.replace(c, F.lit("\\"), F.lit("/")))


def clean_path(c: Column) -> Column:
    """:func:`tidy_path`, null as ``""``; ``a.b/rest`` becomes ``rest`` where ``rest`` holds ``a/b``."""

    def shortened(text: Column) -> Column:
        head = F.substring_index(text, "/", 1)
        rest = F.substring(text, F.length(head) + 2, F.length(text))
        repeated = F.contains(head, F.lit(".")) & F.contains(text, F.lit("/")) & F.contains(rest, F.replace(head, F.lit("."), F.lit("/")))
        return F.when(repeated, rest).otherwise(text)

    return let(F.coalesce(tidy_path(c.cast("string")), F.lit("")), shortened)


def last_part(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def path_stem(c: Column) -> Column:
    """File name without its last extension; a leading dot belongs to the name."""
    return F.regexp_replace(last_part(F.regexp_replace(c, "/+$", ""), "/"), r"(?<=.)\.[^.]+$", "")


def java_name(c: Column) -> Column:
    """Dotted name of a member: up to ``(``, with ``$`` and ``/`` as dots, without ``.java``."""
    return F.regexp_replace(F.translate(F.substring_index(c, "(", 1), "$/", ".."), r"\.java$", "")


def java_entity(name: Column, kind: Column) -> Column:
    """Entity that a Java member belongs to: its parent for functions and variables, else itself."""
    value = java_name(name)
    parent = F.when(F.contains(value, F.lit(".")), F.regexp_replace(value, r"\.[^.]*$", "")).otherwise(value)
    return F.when(F.coalesce(kind, F.lit("")).isin("function", "var"), parent).otherwise(value)


def java_member(name: Column) -> Column:
    return last_part(java_name(name), ".")


def plain_member(path: Column, name: Column, kind: Column) -> Column:
    """Member name in other languages: the file's stem for files, else the last dotted part before ``(``."""
    return F.when(kind == "file", path_stem(path)).otherwise(last_part(F.substring_index(name, "(", 1), "."))


def java_file_entity(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "/$", ".."), r"\.java$", "")


def is_test_path(c: Column) -> Column:
    """Whether a path segment is ``test`` or ``tests``."""
    return F.arrays_overlap(F.split(F.lower(clean_path(c)), "/"), F.array(F.lit("test"), F.lit("tests")))


def is_labelled(c: Column) -> Column:
    return F.coalesce(~F.lower(trimmed(c.cast("string"))).isin(*UNLABELLED), F.lit(False))


def normalize_module(c: Column) -> Column:
    return F.lower(trimmed(c.cast("string")))


def normalize_modules(c: Column) -> Column:
    """Module names of a text that holds a JSON or quoted list, or one name: lowered, labelled, first occurrences."""

    def names(text: Column) -> Column:
        quoted = F.regexp_replace(F.regexp_replace(text, r"^\(", "["), r",?\s*\)$", "]")
        listed = F.when(text.rlike(r"^[\[(].*[\])]$"), F.from_json(quoted, "array<string>", {"allowSingleQuotes": "true"}))
        return F.array_distinct(F.filter(F.transform(F.coalesce(listed, F.array(text)), normalize_module), is_labelled))

    return F.coalesce(let(trimmed(c), names), F.array().cast("array<string>"))


def module_tokens(c: Column) -> Column:
    """Tokens of a module or path: letters and digits, without a numbering prefix and without stop tokens."""
    bare = F.regexp_replace(F.lower(c), r"^[0-9]+[a-z]?__", "")
    return F.filter(F.split(bare, "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(*STOP_TOKENS))


def path_tokens(c: Column) -> Column:
    """Lower-cased directory segments of a path, empty ones left out."""
    parts = F.split(F.lower(c), "/")
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")


def prefixes(tokens: Column) -> Column:
    """All prefixes of a token list, joined by slashes; empty for the empty list."""
    return F.transform(F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(tokens, 1, i), "/"))


def module_score(path: Column, entity: Column, module: Column) -> Column:
    """How well a module fits a file: ``struct(points, hits, specificity, name)``, larger is better.

    200 points if the module's path lies in the file's path, 120 if its dotted form lies in the entity, 20 for each
    of its tokens found, 50 if its tokens stand together.
    """
    file_text, entity_text = F.lower(clean_path(path)), F.lower(F.coalesce(entity, F.lit("")))
    name = normalize_module(module)
    text = F.concat_ws(" ", file_text, F.replace(file_text, F.lit("/"), F.lit(".")), entity_text)
    tokens, found = module_tokens(name), module_tokens(text)
    hits = F.size(F.filter(tokens, lambda x: F.array_contains(found, x) | F.contains(file_text, x) | F.contains(entity_text, x)))
    direct = F.when(F.contains(file_text, F.replace(name, F.lit("."), F.lit("/"))), 200).otherwise(0) + F.when(F.contains(entity_text, F.replace(name, F.lit("/"), F.lit("."))), 120).otherwise(0)
    together = F.contains(file_text, F.array_join(tokens, "/")) | F.contains(entity_text, F.array_join(tokens, ".")) | F.contains(F.translate(text, "/.", ""), F.array_join(tokens, ""))
    points = direct + 20 * hits + F.when((F.size(tokens) > 0) & together, 50).otherwise(0)
    return F.struct(points.alias("points"), hits.alias("hits"), F.length(F.array_join(tokens, "")).alias("specificity"), name.alias("name"))


def best_module(path: Column, entity: Column, modules: Column) -> Column:
    """The module of a list with the highest score; a list of one is taken as it is, an empty one gives null."""
    ranked = F.array_max(F.transform(modules, lambda m: module_score(path, entity, m)))
    return F.when(F.size(modules) == 1, F.element_at(modules, 1)).otherwise(ranked["name"])


def slug(c: Column) -> Column:
    """Letters, digits, ``_`` and ``-`` kept, others ``_``; no underscore at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
