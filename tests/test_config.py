import pytest

from mergelens.sources import config as c


def test_scopes_keep_what_the_other_sets(tmp_path):
    (tmp_path / "user.yaml").write_text("budgets: {review_tokens: 999}\n")
    (tmp_path / "repo.yaml").write_text("mode: agent\n")
    got, warnings = c.load([str(tmp_path / "user.yaml"), str(tmp_path / "repo.yaml"), str(tmp_path / "none.yaml")])
    assert (got["budgets.review_tokens"], got["mode"], got["budgets.agent_timeout_sec"]) == (999, "agent", 90)
    assert len(warnings) == 1


def test_an_explicit_default_overrides():
    assert c.merge([{"mode": "online"}, {"mode": "offline"}])["mode"] == "offline"
    assert c.merge([{"rules.include": ["a", "b"]}, {"rules.include": ["c"]}])["rules.include"] == ["c"]


def test_unknown_keys_warn():
    found, warnings = c.parse_config("mode: online\nbanana: 1\nproviders: [{name: a, model: b, banana: 2}]\nbudgets: {x: 1}\n", "f")
    assert found["mode"] == "online" and sorted(w.split()[-1] for w in warnings) == ["banana", "budgets.x", "providers.banana"]


def test_bad_documents():
    for bad in ("", "- a\n", "a: [", "# nothing\n"):
        with pytest.raises(c.ConfigError):
            c.parse_config(bad)
    for bad in ({"mode": "x"}, {"budgets.review_tokens": 0}, {"providers": [{"name": " ", "model": "m"}]}, {"providers": [{"name": "a", "model": "m", "api_key_env": "MCAI_X"}]}):
        with pytest.raises(c.ConfigError):
            c.validate(c.merge([bad]))


@pytest.mark.parametrize(("provider", "local"), [({}, True), ({"base_url": "http://x"}, False), ({"base_url": "http://x", "local": True}, True), ({"local": False}, False), ({"base_url": ""}, True)])
def test_locality(provider, local):
    assert c.is_local(provider) is local


def test_merge_over_rows(spark):
    df = spark.createDataFrame([("mode", "a", 0), ("mode", "b", 2), ("mode", "c", 1), ("x", "d", 0)], "key string, value string, scope_rank int")
    assert {r.key: r.value for r in c.merge_frame(df).collect()} == {"mode": "b", "x": "d"}
