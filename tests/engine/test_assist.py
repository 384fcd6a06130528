import pytest

from lumenseek.plans import assist


def test_completion():
    c = assist.completion("repo:core path:src/ma*")
    assert (c.mode, c.term, c.key, c.repos, c.start) == ("path", "src/ma", "path", ("core",), 10)
    assert assist.completion("-repo:core nam").repos == ()
    assert assist.completion("nam").mode == "symbol"
    assert assist.completion('"a:b').mode == "symbol"
    assert assist.completion("regex:x").mode == "none"
    assert assist.completion("name ").mode == "symbol"
    assert assist.completion("").mode == "none"
    assert assist.completed("repo:co", 0, "repo:core") == "repo:core"
    assert assist.completed("name", 4, "lang:go") == "name lang:go"


def test_chips():
    text = '-lang:go repo:"a b" ("x:y" or word)'
    assert assist.chips(text) == [("-lang: go", "-lang:go"), ("repo: a b", 'repo:"a b"')]
    assert assist.without_word(text, "-lang:go") == 'repo:"a b" ( "x:y" or word )'
    assert assist.with_word("name", "lang:go") == "name lang:go"
    assert assist.with_word("name lang:go", "lang:go") == "name lang:go"


@pytest.mark.parametrize(
    ("path", "query"),
    [
        ("/repo/core", "repo:core"),
        ("/repo/core/tree/main/src/a.rs", "repo:core branch:main path:src/a.rs"),
        ("/repo/Two%20Words/tree/v%2F1/my%20docs/", 'repo:"Two Words" branch:v/1 path:"my docs/*"'),
        ("/repo/core/tree/main/", "repo:core branch:main"),
        ("/other", ""),
        ("/repo", ""),
    ],
)
def test_addresses(path, query):
    assert assist.query_of_address(path) == query


def test_durations():
    assert assist.seconds("1h30m") == 5400
    assert assist.seconds("2 weeks") == 1209600
    assert assist.snapshot_policy("7d:4") == (604800, 4)
    for bad in ("7d", "0s:1", "7d:0", "x:1", "7y:1", "7d:x"):
        with pytest.raises(ValueError):
            assist.snapshot_policy(bad)


def test_error_codes():
    assert assist.error_code("search", "unknown field `query`") == "search_legacy_query_removed"
    assert assist.error_code("file_list", "Repository x not found") == "file_list_repository_not_found"
    assert assist.error_code("path_search", "query must be non-empty") == "path_search_empty_query"
    assert assist.error_code("search", "boom") == "search_failed"
