"""Properties of the parser, the matcher and text functions over generated sources."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from codequarry.functions import code, match
from codequarry.functions.elixir import ParseError, decode, encode, parse
from codequarry.functions.locations import literal_locations, regex_locations

TOKEN = st.sampled_from("defmodule def do end fn -> | |> ( ) [ ] { } , : \" ' ~w() %{} & @ # \n 1 2.5 :atom Foo.Bar x y! z? \\ <<>> = == <- when \"a#{b}c\" \"\"\" ; .".split(" "))
NAME = st.sampled_from(["a", "b", "total", "x1"])


def expression(children):
    call = st.tuples(st.sampled_from(["f", "Enum.map", "Map.get", "IO.puts", "length"]), st.lists(children, max_size=3)).map(lambda t: f"{t[0]}({', '.join(t[1])})")
    pipe = st.tuples(children, st.sampled_from(["g()", "Enum.uniq()", "h(1)"])).map(lambda t: f"{t[0]} |> {t[1]}")
    items = st.lists(children, max_size=3).map(lambda t: f"[{', '.join(t)}]")
    return st.one_of(call, pipe, items, st.tuples(children, children).map(lambda t: f"({t[0]} + {t[1]})"), st.tuples(children, children).map(lambda t: "{" + f"{t[0]}, {t[1]}" + "}"))


EXPRESSION = st.recursive(st.one_of(NAME, st.integers(0, 99).map(str), st.sampled_from([":ok", '"text"', "nil", "true"])), expression, max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(TOKEN, max_size=30).map(" ".join)))
def test_any_text_is_parsed_or_refused(text):
    got = code.extract("lib/a.ex", text, min_mass=1)
    assert got is None or {"fragments", "definitions", "references", "comments", "edges"} <= set(got)


@settings(max_examples=200, deadline=None)
@given(EXPRESSION)
def test_trees_go_to_json_and_back(text):
    tree = parse(text)
    assert encode(decode(json.loads(json.dumps(encode(tree))))) == encode(tree)


@settings(max_examples=200, deadline=None)
@given(EXPRESSION)
def test_a_source_matches_itself_and_the_hole(text):
    tree = match.compiled(text)
    assert match.match(match.compiled("_"), tree) is not None
    assert match.match(tree, tree) is not None
    assert match.similarity(parse(text), parse(text)) == 1.0


@settings(max_examples=200, deadline=None)
@given(EXPRESSION, st.sampled_from(["f(...)", "Enum.map(_, _)", "Map.get(_, ...)", "length(_)", "_ |> g()", "IO.puts(a)", "[_, _]", "{_, _}", "Enum.uniq(_)"]))
def test_required_terms_are_sound(text, pattern):
    """Whatever a pattern matches has all terms that the pattern requires."""
    source = f"def run(a) do\n  {text}\nend\n"
    got = code.extract("lib/a.ex", source, min_mass=1)
    if got is None:
        return
    rule = match.compiled(pattern)
    need = match.required_terms(rule)
    for f in got["fragments"]:
        tree = match.compiled(decode(json.loads(f["ast"])))
        if match.match(rule, tree) is not None:
            assert need <= set(f["terms"]), (need, f["terms"])


@settings(max_examples=300, deadline=None)
@given(st.text("ab\né ", max_size=40), st.text("ab\n", min_size=1, max_size=3))
def test_locations_point_at_what_was_found(text, literal):
    lines = text.split("\n")
    found = literal_locations(text, literal)
    assert len(found) == text.count(literal)
    for line, column in found:
        assert "\n".join(lines[line - 1 :])[column - 1 :].startswith(literal)
    import re

    assert list(regex_locations(text, re.escape(literal))) == found


def test_bad_patterns_are_refused():
    for bad in ("def (", "f(", "[1,", '"open'):
        try:
            match.compiled(bad)
        except ParseError:
            continue
        raise AssertionError(bad)
