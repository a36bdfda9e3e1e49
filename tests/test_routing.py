import random
from datetime import datetime, timedelta

import pytest

from opsloom.plans.tenancy import route

RULES = "rule_id int, priority int, channel_id string, match_type string, match_value string, target string, active_from timestamp_ntz, active_to timestamp_ntz"
MESSAGES = "message_id int, channel_id string, sender string, body string, ts timestamp_ntz"


def day(n):
    return datetime(2024, 1, 1) + timedelta(hours=n)


def make(pick, n_rules, n_messages, channels, senders):
    letters = "abc "
    rules = []
    for i in range(n_rules):
        kind = pick.choice(["any", "sender", "keyword", "keyword"])
        value = {"any": None, "sender": pick.choice(senders), "keyword": "".join(pick.choice(letters) for _ in range(pick.randint(0, 6)))}[kind]
        start = pick.choice([None, pick.randint(0, 400)])
        end = pick.choice([None, (start or 0) + pick.randint(-5, 200)])
        rules.append((i, pick.randint(1, 50), pick.choice(channels), kind, value, f"t{i}", None if start is None else day(start), None if end is None else day(end)))
    messages = [(i, pick.choice(channels), pick.choice([*senders, None]), pick.choice([None, "", "".join(pick.choice(letters) for _ in range(pick.randint(1, 25)))]),
                 day(pick.randint(-20, 500))) for i in range(n_messages)]
    return rules, messages


def brute(rules, message):
    _, channel, sender, body, ts = message
    fit = [(r[1], r[0], r[5]) for r in rules if r[2] == channel and (r[6] is None or r[6] <= ts) and (r[7] is None or ts < r[7])
           and (r[3] == "any" or r[3] == "sender" and r[4] == sender or r[3] == "keyword" and r[4] is not None and (r[4] == "" or body is not None and r[4] in body))]
    return min(fit)[1:] if fit else (None, None)


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_trying_every_rule(spark, seed):
    rules, messages = make(random.Random(seed), 120, 300, ["x", "y", "z", None], ["s1", "s2", "s3"])
    rules += [(900, 0, "y", "keyword", None, "never", None, None), (901, 0, "w", "keyword", "é", "accent", None, None)]
    messages.append((5000, "w", None, "caf\xe9", day(1)))
    got = {r.message_id: (r.rule_id, r.target) for r in route(
        spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(rules, RULES), "ts").collect()}
    rules = [r for r in rules if r[2] is not None]
    want = {m[0]: brute(rules, m) if m[1] is not None else (None, None) for m in messages}
    assert got == want and got[5000] == (901, "accent")
    assert any(v[0] is None for v in got.values())


def test_a_hundred_thousand_rules_of_one_channel(spark):
    pick = random.Random(3)
    senders = [f"s{i}" for i in range(30_000)]
    rules = [(i, pick.randint(10, 99), "x", "sender", pick.choice(senders), f"t{i}", None, None) for i in range(50_000)]
    rules += [(50_000 + i, pick.randint(10, 99), "x", "keyword", f"order {i} ", f"k{i}", None, None) for i in range(30_000)]
    rules += [(90_000 + i, pick.randint(50, 9999), "x", "any", None, f"a{i}", day(i), day(i + pick.randint(1, 500))) for i in range(20_000)]
    messages = [(i, "x", pick.choice([*senders, "none"]), f"about order {pick.randint(0, 40_000)} please", day(pick.randint(0, 21_000))) for i in range(2000)]
    got = {r.message_id: r.rule_id for r in route(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(rules, RULES), "ts").collect()}
    assert len(got) == 2000
    for m in messages[::40]:
        assert got[m[0]] == brute(rules, m)[0]


def test_no_rules(spark):
    out = route(spark.createDataFrame([(1, "x", "s", "b", day(0))], MESSAGES), spark.createDataFrame([], RULES), "ts").collect()
    assert [(r.message_id, r.routing) for r in out] == [(1, "missed")]
