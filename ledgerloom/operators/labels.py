"""The label contract: fourteen fields, each a value with wording, availability and origin.

Shapes say what a value may be. Each can look at a parsed tree (`why`) and at a variant column (`told`),
and both follow one table of rules for fields, so that they find the same faults in the same order.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from types import SimpleNamespace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import NotStrict, strict_loads, strict_variant
from ..functions.text import json_quoted

# Names and vocabularies of the contract.
AVAILABILITY = ("PRESENT", "ABSENT_IN_CONTEXT", "AMBIGUOUS", "UNREADABLE", "CONFLICTING", "NOT_APPLICABLE")
DIRECTIONS = ("FOR", "AGAINST", "ABSTAIN", "WITHHOLD", "OTHER")
ALIGNMENTS = ("WITH_MANAGEMENT", "AGAINST_MANAGEMENT", "NOT_APPLICABLE", "OTHER")
ORIGINS = ("EXTRACTED", "DERIVED")
PARTS = ("value", "raw_text", "availability", "origin")

Fault = tuple[str, str]
FAULTS = "array<struct<path:string,rule:string>>"
QUOTES = "array<struct<path:string,quote:string>>"


class Sql(str):
    """A condition in SQL, with the operators that the table of rules uses."""

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self})")

    def __and__(self, other: str) -> Sql:
        return Sql(f"({self} AND {other})")


_fresh = map("v{}".format, itertools.count())


def _let(x: str, f: Callable[[str], str]) -> str:
    """f of x, which stands in the expression once."""
    name = next(_fresh)
    return f"get(transform(array({x}), {name} -> {f(name)}), 0)"


def _none(kind: str) -> str:
    return f"cast(array() as {kind})"


def _fault(at: str, rule: str) -> str:
    return f"array(named_struct('path', {at}, 'rule', {rule}))"


def _members(v: str) -> str:
    """The members of a JSON object, null for anything else."""
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def _items(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def _string(v: str) -> str:
    """A JSON string, null for anything else."""
    return f"if(schema_of_variant({v}) = 'STRING', try_variant_get({v}, '$', 'string'), null)"


def _is_null(v: str) -> str:
    return f"is_variant_null({v})"


def _yes(condition: str) -> Sql:
    return Sql(f"coalesce({condition}, false)")


def _told_names(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _inside(at: str, name: str) -> str:
    return f"concat({at}, '{name}')"


def _sound_keys(members: str, names, at: str, then: str) -> str:
    """`then` for an object with just these members, else what is wrong with it."""
    return f"CASE WHEN {members} IS NULL THEN {_fault(at, repr('not_an_object'))} WHEN array_sort(map_keys({members})) <> array({_told_names(sorted(names))}) THEN {_fault(at, repr('keys'))} ELSE {then} END"


def _of(column: Column, f: Callable[[str], str]) -> Column:
    """f, which gives SQL over a name, of a column. One parsed expression instead of thousands of calls."""
    name = next(_fresh)
    return F.get(F.call_function("transform", F.array(column), F.expr(f"{name} -> {f(name)}")), F.lit(0))


def _unlike(node: Any, names) -> str | None:
    if not isinstance(node, dict):
        return "not_an_object"
    return None if node.keys() == set(names) else "keys"


class Text:
    """Any string."""

    type = "string"

    def why(self, node: Any, at: str) -> Iterator[Fault]:
        if not isinstance(node, str):
            yield at, "not_text"

    def told(self, v: str, at: str) -> str:
        return f"CASE WHEN {_string(v)} IS NULL THEN {_fault(at, repr('not_text'))} ELSE {_none(FAULTS)} END"

    def schema(self) -> str:
        """A pattern of the schema that a variant of the shape has."""
        return "STRING"

    def sound(self, x: str) -> str:
        """SQL of whether a typed value has no fault."""
        return f"{x} IS NOT NULL"

    def quotes(self, v: str, at: str) -> str:
        return _none(QUOTES)


class Choice(Text):
    """One string of a closed set."""

    def __init__(self, *names: str):
        self.names = names

    def why(self, node: Any, at: str) -> Iterator[Fault]:
        if node not in self.names:
            yield at, "unknown_value"

    def told(self, v: str, at: str) -> str:
        return f"CASE WHEN {_yes(f'{_string(v)} IN ({_told_names(self.names)})')} THEN {_none(FAULTS)} ELSE {_fault(at, repr('unknown_value'))} END"

    def sound(self, x: str) -> str:
        return _yes(f"{x} IN ({_told_names(self.names)})")


class Record:
    """An object of just these fields."""

    def __init__(self, **shapes):
        self.fields = {name: Field(shape) for name, shape in shapes.items()}
        self.type = "struct<" + ",".join(f"{name}:{f.type}" for name, f in self.fields.items()) + ">"

    def why(self, node: Any, at: str) -> Iterator[Fault]:
        if rule := _unlike(node, self.fields):
            yield at, rule
        else:
            for name, f in self.fields.items():
                yield from f.why(node[name], f"{at}.{name}")

    def told(self, v: str, at: str) -> str:
        each = lambda m: ", ".join(f.told(f"{m}['{name}']", _inside(at, f".{name}")) for name, f in self.fields.items())
        return _let(_members(v), lambda m: _sound_keys(m, self.fields, at, f"concat({each(m)})"))

    def schema(self) -> str:
        return f"OBJECT<{', '.join(f'{name}: {f.schema()}' for name, f in sorted(self.fields.items()))}>"

    def sound(self, x: str) -> str:
        return f"({x} IS NOT NULL AND {' AND '.join(f.sound(f'{x}.{name}') for name, f in self.fields.items())})"

    def quotes(self, v: str, at: str) -> str:
        each = lambda m: ", ".join(f.quotes(f"{m}['{name}']", _inside(at, f".{name}")) for name, f in self.fields.items())
        return _let(_members(v), lambda m: f"concat({each(m)})")


class Filled:
    """A list of one or more."""

    def __init__(self, of):
        self.of = of
        self.type = f"array<{of.type}>"

    def why(self, node: Any, at: str) -> Iterator[Fault]:
        if not isinstance(node, list) or not node:
            yield at, "not_a_filled_list"
        else:
            for i, x in enumerate(node):
                yield from self.of.why(x, f"{at}[{i}]")

    def _each(self, items: str, at: str, look: Callable[[str, str], str]) -> str:
        x, i = next(_fresh), next(_fresh)
        return f"flatten(transform({items}, ({x}, {i}) -> {look(x, f"concat({at}, '[', {i}, ']')")}))"

    def told(self, v: str, at: str) -> str:
        return _let(_items(v), lambda a: f"CASE WHEN coalesce(size({a}), 0) < 1 THEN {_fault(at, repr('not_a_filled_list'))} ELSE {self._each(a, at, self.of.told)} END")

    def schema(self) -> str:
        return f"ARRAY<(?:VOID|{self.of.schema()})>"

    def sound(self, x: str) -> str:
        m = next(_fresh)
        return f"(coalesce(size({x}), 0) > 0 AND forall({x}, {m} -> {self.of.sound(m)}))"

    def quotes(self, v: str, at: str) -> str:
        return self._each(_items(v), at, self.of.quotes)


#: What decides about a field before its value does: the first that holds. No rule: the field is sound.
FIELD_TABLE: tuple[tuple[str, Callable], ...] = (
    ("unknown_availability", lambda f: ~f.known),
    ("wording_not_text", lambda f: ~f.worded),
    ("", lambda f: f.rightly_empty),
    ("unresolved_but_filled", lambda f: ~f.present & f.filled),
    ("", lambda f: ~f.present),
    ("no_origin", lambda f: ~f.has_origin),
)


class Field:
    """A value of some shape with its wording, availability and origin."""

    def __init__(self, shape, may_be_empty: bool = False):
        self.shape, self.may_be_empty = shape, may_be_empty
        self.type = f"struct<value:{shape.type},raw_text:string,availability:string,origin:string>"

    def why(self, node: Any, at: str) -> Iterator[Fault]:
        if rule := _unlike(node, PARTS):
            yield at, rule
            return
        value, raw, state, origin = (node[p] for p in PARTS)
        facts = {
            "known": state in AVAILABILITY, "worded": raw is None or isinstance(raw, str), "present": state == "PRESENT", "filled": not (value is None and origin is None),
            "has_origin": origin in ORIGINS, "rightly_empty": self.may_be_empty and value == [] and state == "NOT_APPLICABLE" and origin == "DERIVED",
        }
        view = SimpleNamespace(**{k: np.bool_(x) for k, x in facts.items()})
        for rule, holds in FIELD_TABLE:
            if holds(view):
                if rule:
                    yield at, rule
                return
        yield from self.shape.why(value, at)
        if value == "OTHER" and not raw:
            yield at, "other_without_wording"

    def told(self, v: str, at: str) -> str:
        """SQL of the faults of a variant, as array<struct<path,rule>>."""

        def inside(m: str) -> str:
            value, raw, state, origin = (f"{m}['{p}']" for p in PARTS)
            empty = _yes(f"size({_items(value)}) = 0") & _yes(f"{_string(state)} = 'NOT_APPLICABLE'") & _yes(f"{_string(origin)} = 'DERIVED'")
            view = SimpleNamespace(
                known=_yes(f"{_string(state)} IN ({_told_names(AVAILABILITY)})"), worded=Sql(f"({_is_null(raw)} OR {_string(raw)} IS NOT NULL)"), present=_yes(f"{_string(state)} = 'PRESENT'"),
                filled=~Sql(f"({_is_null(value)} AND {_is_null(origin)})"), has_origin=_yes(f"{_string(origin)} IN ({_told_names(ORIGINS)})"), rightly_empty=empty if self.may_be_empty else Sql("false"),
            )
            rows = " ".join(f"WHEN {holds(view)} THEN {_fault(at, repr(rule)) if rule else _none(FAULTS)}" for rule, holds in FIELD_TABLE)
            unworded = _yes(f"{_string(value)} = 'OTHER'") & f"coalesce({_string(raw)}, '') = ''"
            after = f"concat({self.shape.told(value, at)}, CASE WHEN {unworded} THEN {_fault(at, repr('other_without_wording'))} ELSE {_none(FAULTS)} END)"
            return _sound_keys(m, PARTS, at, f"CASE {rows} ELSE {after} END")

        return _let(_members(v), inside)

    def schema(self) -> str:
        return f"OBJECT<availability: STRING, origin: (?:STRING|VOID), raw_text: (?:STRING|VOID), value: (?:VOID|{self.shape.schema()})>"

    def sound(self, x: str) -> str:
        """SQL of whether a typed field has no fault; that its parts are all there and of their types is not looked at."""
        state, origin, value = f"{x}.availability", f"{x}.origin", f"{x}.value"
        worded = f" AND NOT ({value} = 'OTHER' AND coalesce({x}.raw_text, '') = '')" if isinstance(self.shape, Text) else ""
        present = f"{state} = 'PRESENT' AND {_yes(f"{origin} IN ({_told_names(ORIGINS)})")} AND {self.shape.sound(value)}{worded}"
        empty = f" OR ({state} = 'NOT_APPLICABLE' AND {_yes(f"{origin} = 'DERIVED'")} AND {_yes(f'size({value}) = 0')})" if self.may_be_empty else ""
        return f"({_yes(f'{state} IN ({_told_names(AVAILABILITY)})')} AND (({present}) OR ({state} <> 'PRESENT' AND {value} IS NULL AND {origin} IS NULL){empty}))"

    def quotes(self, v: str, at: str) -> str:
        """SQL of the wordings that are not empty, with their paths, of a variant that holds a sound field."""

        def inside(m: str) -> str:
            raw = _string(f"{m}['raw_text']")
            own = f"CASE WHEN length({raw}) > 0 THEN array(named_struct('path', {at}, 'quote', {raw})) ELSE {_none(QUOTES)} END"
            return f"concat({own}, coalesce({self.shape.quotes(f"{m}['value']", _inside(at, '.value'))}, {_none(QUOTES)}))"

        return _let(_members(v), inside)


def _identifiers() -> Filled:
    return Filled(Record(source_label=Text(), value=Text()))


# The fields of the contract.
CONTRACT = {
    "reporting_scope": Field(Record(name=Text(), scope_type=Choice("INDIVIDUAL_FUND", "FUND_GROUP"), members=Filled(Field(Text())))),
    "series_identifiers": Field(_identifiers()),
    "issuer_name": Field(Text()),
    "security_identifiers": Field(_identifiers()),
    "ticker": Field(Text()),
    "meeting_date": Field(Text()),
    "meeting_type": Field(Text()),
    "proposal_number": Field(Text()),
    "raw_description": Field(Text()),
    "separate_subject": Field(Text()),
    "proposal_source": Field(Text()),
    "participation": Field(Choice("VOTED", "DID_NOT_VOTE", "OTHER")),
    "vote_components": Field(Filled(Record(direction=Choice(*DIRECTIONS), quantity=Record(amount=Text(), unit=Text()), disclosed_management_alignment=Choice(*ALIGNMENTS))), may_be_empty=True),
    "management_recommendation": Field(Choice(*DIRECTIONS, "NONE")),
}

#: Spark type of a whole label's fields; the nesting is finite, so that it is one static type.
LABEL_TYPE = "struct<" + ",".join(f"{name}:{f.type}" for name, f in CONTRACT.items()) + ">"


@dataclass(frozen=True)
class Across:
    """A rule over fields that are sound each: where it is told, the fields, and when a tree or a variant map breaks it."""

    at: str
    rule: str
    needs: tuple[str, ...]
    why: Callable[[dict], bool]
    told: Callable[[Callable[[str], str]], str]


def _no_calendar_day(text: str) -> bool:
    try:
        return date.fromisoformat(text).isoformat() != text
    except ValueError:
        return True


def _odd_day(part: Callable[[str], str]) -> str:
    day = _string(f"{part('meeting_date')}['value']")
    return f"({day} IS NOT NULL AND (try_to_date({day}, 'yyyy-MM-dd') IS NULL OR NOT {day} RLIKE '^(?!0000)[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'))"


def _votes_differ(part: Callable[[str], str]) -> str:
    silent, votes = _string(f"{part('participation')}['value']"), _items(f"{part('vote_components')}['value']")
    return f"({_yes(f"{silent} = 'DID_NOT_VOTE'")} <> {_yes(f'size({votes}) = 0')})"


ACROSS = (
    Across("meeting_date", "not_a_calendar_date", ("meeting_date",), lambda f: f["meeting_date"]["value"] is not None and _no_calendar_day(f["meeting_date"]["value"]), _odd_day),
    Across("vote_components", "votes_and_participation_differ", ("participation", "vote_components"), lambda f: (f["participation"]["value"] == "DID_NOT_VOTE") != (f["vote_components"]["value"] == []), _votes_differ),
)


def problems(label: Any) -> Iterator[Fault]:
    """(path, rule) of all that is wrong with a parsed label, in the order of the contract."""
    for at, node, names in (("label", label, ("fields",)), ("fields", label["fields"] if isinstance(label, dict) and "fields" in label else None, CONTRACT)):
        if rule := _unlike(node, names):
            yield at, rule
            return
    fields = label["fields"]
    found = {name: list(f.why(fields[name], name)) for name, f in CONTRACT.items()}
    for faults in found.values():
        yield from faults
    for x in ACROSS:
        if not any(found[n] for n in x.needs) and x.why(fields):
            yield x.at, x.rule


def parse_label(text: str | None) -> dict | None:
    """A valid label, or None."""
    try:
        label = strict_loads(text) if text is not None else None
    except NotStrict:
        return None
    return label if label is not None and next(problems(label), None) is None else None


def _faults_of(label: str) -> str:
    """SQL of problems() of a variant, as array<struct<path,rule>>."""

    def of_fields(m: str) -> str:
        each = ", ".join(f"'{name}', {f.told(f"{m}['{name}']", repr(name))}" for name, f in CONTRACT.items())

        def across(found: str) -> str:
            sound = lambda x: " AND ".join(f"size({found}['{n}']) = 0" for n in x.needs)
            rows = [f"CASE WHEN {sound(x)} THEN CASE WHEN {x.told(lambda n: _members(f"{m}['{n}']"))} THEN {_fault(repr(x.at), repr(x.rule))} ELSE {_none(FAULTS)} END ELSE {_none(FAULTS)} END" for x in ACROSS]
            return f"concat({', '.join([*(f"{found}['{n}']" for n in CONTRACT), *rows])})"

        return _sound_keys(m, CONTRACT, "'fields'", _let(f"map({each})", across))

    return _let(_members(label), lambda m: _sound_keys(m, ("fields",), "'label'", _let(_members(f"{m}['fields']"), of_fields)))


def is_sound(v: str) -> str:
    """SQL of whether a variant is a label without fault; cheaper than to list all faults.

    Its schema must be that of a label, and of each member of its lists that of a member, as a list's own schema is merged from
    them; then every field of the static struct must keep the rules.
    """
    lists = [(f"$.fields.{n}.value", f.shape.of) for n, f in CONTRACT.items() if isinstance(f.shape, Filled)]
    lists += [(f"$.fields.{n}.value.{k}.value", g.shape.of) for n, f in CONTRACT.items() if isinstance(f.shape, Record) for k, g in f.shape.fields.items() if isinstance(g.shape, Filled)]
    whole = f"^OBJECT<fields: OBJECT<{', '.join(f'{n}: {f.schema()}' for n, f in sorted(CONTRACT.items()))}>>$"
    alike = " AND ".join(_let(f"try_variant_get({v}, '{at}', 'array<variant>')", lambda a, of=of: f"(coalesce(size({a}), 0) < 2 OR forall({a}, _m -> schema_of_variant(_m) RLIKE '^{of.schema()}$'))") for at, of in lists)

    def keeps(w: str) -> str:
        part = lambda n: f"{w}.fields.{n}"
        day = f"{part('meeting_date')}.value"
        dated = f"({day} IS NULL OR (try_to_date({day}, 'yyyy-MM-dd') IS NOT NULL AND {day} RLIKE '^(?!0000)[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'))"
        voted = f"{_yes(f"{part('participation')}.value = 'DID_NOT_VOTE'")} = {_yes(f"size({part('vote_components')}.value) = 0")}"
        fields = " AND ".join(f.sound(part(n)) for n, f in CONTRACT.items())
        return f"coalesce({w} IS NOT NULL AND schema_of_variant({v}) RLIKE '{whole}' AND {alike} AND {fields} AND {dated} AND {voted}, false)"

    return _let(f"try_variant_get({v}, '$', 'struct<fields:{LABEL_TYPE}>')", keeps)


def label_problems(text: Column) -> Column:
    """array<struct(path, rule)> of a JSON label; a text that is no strict JSON has one entry, (label, json).

    The strict parse and the rules are expressions over the parsed variant.
    """
    return _of(strict_variant(text), lambda v: f"CASE WHEN {v} IS NULL THEN {_fault("'label'", "'json'")} ELSE {_faults_of(v)} END")


def wordings_of(members: str) -> str:
    """SQL of the wordings that are not empty, with their paths, of the members of a valid label."""
    return f"concat({', '.join(f.quotes(f"{members}['{name}']", repr(name)) for name, f in CONTRACT.items())})"


def quotations(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, path, quote): every wording that is not empty in valid JSON labels, with list places in its path."""
    found = _of(F.try_parse_json(label), lambda v: _let(f"try_variant_get({v}, '$.fields', 'map<string,variant>')", wordings_of))
    return labels.select(key, F.explode(found).alias("q")).select(key, "q.path", "q.quote")


def typed_label(text: Column) -> Column:
    """The label as a static struct, for labels already found valid."""
    return F.from_json(text, f"struct<fields:{LABEL_TYPE}>")


def field_at(label: Column, path: Column) -> Column:
    """The node of a JSON label at a path such as fields.a.b[0].c, as a variant; null where there is none."""
    return F.when(path.startswith("fields."), F.try_variant_get(F.try_parse_json(label), F.concat(F.lit("$."), path), "variant"))


def review_fields(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, field, value, raw_text, availability, origin, evidence_input, note): editable texts of each field of
    valid labels; values and wordings are JSON without spaces, a null origin is empty."""
    # The label is read once, before its fields become rows.
    names, n = ", ".join(f"'{x}'" for x in CONTRACT), next(_fresh)
    parts = _of(F.try_parse_json(label), lambda v: _let(f"try_variant_get({v}, '$.fields', 'map<string,variant>')", lambda m: f"transform(array({names}), {n} -> named_struct('field', {n}, 'f', {_members(f'{m}[{n}]')}))"))
    each = labels.select(key, F.explode(parts).alias("x")).select(key, "x.field", "x.f")
    told = lambda name: F.to_json(F.col("f")[name])
    text = lambda name: F.coalesce(F.try_variant_get(F.col("f")[name], "$", "string"), F.lit(""))
    return each.select(key, "field", told("value").alias("value"), told("raw_text").alias("raw_text"), text("availability").alias("availability"), text("origin").alias("origin"), F.lit("").alias("evidence_input"), F.lit("").alias("note"))


def review_results(fields: DataFrame, key: str) -> DataFrame:
    """(key, label, faults): what edited texts spell, a row for each key; the label is null where there is a fault.

    fields: key, field, value, raw_text, availability, origin, as review_fields() tells them. Values and wordings are strict
    JSON, an empty origin is none. A field that is told twice, is missing or is none of the contract, and a text that is no JSON, are faults.
    """
    quoted = lambda c: json_quoted(F.col(c))
    json_of = lambda c: F.when(F.col(c) == "null", "null").otherwise(F.to_json(strict_variant(F.col(c))))
    state = F.when(F.col("availability").isin(*AVAILABILITY), F.concat(F.lit('"'), F.col("availability"), F.lit('"'))).otherwise(F.coalesce(quoted("availability"), F.lit("null")))
    origin = F.when(F.coalesce(F.col("origin"), F.lit("")) == "", "null").when(F.col("origin").isin(*ORIGINS), F.concat(F.lit('"'), F.col("origin"), F.lit('"'))).otherwise(quoted("origin"))
    spelled = F.concat(F.lit('{"value": '), json_of("value"), F.lit(', "raw_text": '), json_of("raw_text"), F.lit(', "availability": '), state, F.lit(', "origin": '), origin, F.lit("}"))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, CONTRACT)), F.col("field")), F.lit(0))
    name = F.when(place > 0, F.concat(F.lit('"'), F.col("field"), F.lit('"'))).otherwise(quoted("field"))
    each = fields.select(key, F.struct(place.alias("place"), "field", F.concat(name, F.lit(": "), spelled).alias("told")).alias("x"))
    unread = F.collect_list(F.when(F.col("x.told").isNull(), F.struct(F.coalesce("x.field", F.lit("fields")).alias("path"), F.lit("json").alias("rule"))))
    whole = F.concat(F.lit('{"fields": {'), F.array_join(F.sort_array(F.collect_list("x"))["told"], ", "), F.lit("}}"))
    told = each.groupBy(key).agg(whole.alias("label"), unread.alias("unread"))
    faults = F.when(F.size("unread") > 0, F.col("unread")).otherwise(label_problems(F.col("label")))
    # A generated row keeps the problems from being looked for twice.
    found = told.select(key, "label", F.explode(F.array(faults)).alias("faults"))
    return found.select(key, F.when(F.size("faults") == 0, F.col("label")).alias("label"), "faults")


def from_review(fields: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The labels that edited texts spell, (key, label), and what is wrong with others, (key, path, rule), of review_results()."""
    found = review_results(fields, key)
    return found.where("label is not null").select(key, "label"), found.select(key, F.explode("faults").alias("p")).select(key, "p.path", "p.rule")
