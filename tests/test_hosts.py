"""Hosts by the words of names: equal to comparing every name with every host."""

import random

from motorlens.operators import hosts


def test_anchors_and_hosts(spark):
    names = [(1, "Garage Müller & Söhne GmbH", "DE"), (2, "Auto SA", "FR"), (3, "The Motors", "NL"), (4, None, "DE"), (5, "Müller", "XX"), (6, "ŒUVRE ﬁne Cars", "FR"), (7, "Garage Müller & Söhne GmbH", "DE"), (8, "soehne zzz", "DE")]
    issued = [("*.Mueller-sohne.de",), ("www.muller-sohne.de",), ("sohnemuller.de",), ("shop.soehne.de",), ("the-motors.nl",), ("motorsthe.nl",), ("muller sohne.de",), ("mullersohne.fr",), ("de",), (None,), ("fine-uvre.fr",)]
    rows = hosts.hosts_of(spark.createDataFrame(names, "id int, name string, country string"), spark.createDataFrame(issued, "name_value string")).collect()
    got = {r["id"]: (r["anchors"], r["host"]) for r in rows}
    assert len(rows) == len(names)
    assert got[1] == got[7] == ("muller sohne", "sohnemuller.de") and got[2] == ("", None) and got[3] == ("motors the", "motorsthe.nl")
    assert got[4] == ("", None) and got[5] == ("muller", None) and got[6] == ("uvre fine", "fine-uvre.fr") and got[8] == ("soehne zzz", None)


def test_index_equals_brute_force(spark):
    random.seed(3)

    def word():
        return "".join(random.choice("abc") for _ in range(random.randint(3, 5)))

    names = [(i, f"{word()} {word()}"[: random.randint(3, 11)], random.choice(["DE", "FR"])) for i in range(300)]
    issued = [("".join(word() for _ in range(random.randint(1, 3))) + random.choice([".de", ".fr", ".com"]),) for _ in range(400)]
    got = {r["id"]: r["host"] for r in hosts.hosts_of(spark.createDataFrame(names, "id int, name string, country string"), spark.createDataFrame(issued, "name_value string")).collect()}
    for i, name, country in names:
        words = sorted((w for w in name.split() if len(w) >= 3), key=len, reverse=True)[:2]
        fits = {h for (h,) in issued if h.endswith("." + country.lower()) and all(w in h.split(".")[0] for w in words)}
        assert got[i] == (min(fits, key=lambda h: (len(h), h)) if words and fits else None), (name, country)


def test_empty_tables(spark):
    names, issued = "id int, name string, country string", "name_value string"
    assert hosts.hosts_of(spark.createDataFrame([], names), spark.createDataFrame([], issued)).count() == 0
    assert [tuple(r) for r in hosts.hosts_of(spark.createDataFrame([(1, "abc", "DE")], names), spark.createDataFrame([], issued)).collect()] == [(1, "abc", None)]
