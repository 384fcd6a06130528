import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenseek.plans import language as q


def test_tokens():
    assert [t.value for t in q.tokenize('one "two three" repo:x')] == ["one", "two three", "repo:x"]
    assert q.tokenize('"a:b"')[0].quoted_colon
    assert not q.tokenize("a:b")[0].quoted_colon
    assert [t.value for t in q.tokenize(r'"say \"hi\""')] == ['say "hi"']
    assert [t.value for t in q.tokenize("(aaa OR bbb)")] == ["(", "aaa", "or", "bbb", ")"]


def test_top_level_or_means_both_unless_strict():
    assert len(q.request("alpha or beta").plans) == 1
    assert len(q.request("alpha or beta", strict=True).plans) == 2
    assert len(q.request("(alpha or beta) (lang:go or lang:c)").plans) == 4


def test_plan_fields():
    (p,) = q.request('"The End" -word repo:r -repo:s file:a/*_?.py lang:go branch:main case:auto historical:yes').plans
    assert p.required == (q.Content("The End"),) and p.excluded == (q.Content("word"),)
    assert (p.repos, p.no_repos, p.langs, p.branches) == (("r",), ("s",), ("go",), ("main",))
    assert p.globs == (r"a/%\__.py",)
    assert p.case_sensitive and p.historical
    assert p.highlight == "The End"


@pytest.mark.parametrize("text", ["ab", "lang:go", "-word", "bogus:x", "type:repo word", "-case:yes word", "case:yes case:no word", "word )", "", "()", r"regex:a\(b"])
def test_refused(text):
    with pytest.raises(ValueError):
        q.request(text)


def test_regexes():
    assert q.line_regex("void") == "(?m)^.*void.*$"
    assert q.line_regex("^void$") == "(?m)^void$"
    assert q.line_regex("f(x)") == r"(?m)^.*f\(x\).*$"
    assert q.line_regex("[^a]b") == "(?m)^.*[^a]b.*$"
    for bad in ("a\\", r"a\nb", r"\(x\)"):
        with pytest.raises(q.SearchSyntaxError):
            q.line_regex(bad)
    assert q.java_regex("(?m)^.*[[:alpha:]].*$", True).startswith("(?md)")
    assert r"\p{Alpha}" in q.java_regex("[[:alpha:]]", True)


def test_budgets():
    assert q.request("thing").fetch_limit == 301
    assert q.request("regex:thing").fetch_limit == 101
    assert q.request("thing", page=1000).fetch_limit == 5000
    assert q.request("thing", page=3).offset == 50


def test_terms_that_look_like_symbols():
    r = q.request('"ns::Name" "two words"')
    assert r.symbol_terms == ["ns::name"] and r.definition_terms == ["name"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab c:"\'()-\\or*?[]^$', max_size=40), st.booleans())
def test_any_text_is_planned_or_refused(text, strict):
    try:
        r = q.request(text, strict=strict)
    except ValueError:
        return
    assert all(p.required for p in r.plans)


def test_compile_and_parse_back():
    text = q.compile_query("needle", repo=["a b"], not_lang="go", case="yes", historical=True)
    (p,) = q.request(text).plans
    assert (p.repos, p.no_langs, p.case, p.historical) == (("a b",), ("go",), "yes", True)
