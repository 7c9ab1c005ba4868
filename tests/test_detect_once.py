"""Detectors: run once a row, in as many tasks as there are cores, with what a text has to hold looked at first."""

import random
import re
import unicodedata

from loomstone.operators import detect
from loomstone.operators.patterns import RULES
from loomstone.plans import registry

SF = "/root/testdata/sf0.001"


def test_filters_do_not_run_the_detectors_again(spark):
    for name in ("b08_annex", "b14_findings", "b15_front_matter_entities"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [") == 1, name


def test_a_small_file_is_dealt_to_all_cores(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet")
    assert detect.dealt(rows, "o_orderkey").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_what_a_rule_needs_is_in_all_it_matches():
    signs = ["RFC 12", "rfc-7", "IſO 9001", "ıso 27001", "GDPR", "Lei 13.709", "Brazil", "BRAſİL", "usa", ", SP.", "Rua das Flores, 12", "PRAÇA da Sé, 9", "CVE-2024-1234", "arXiv: 2401.12345", "ISſN 1234-567X", "commit abcdef1", "12 de março de 2024", "Mar 3, 2024", "3 Mar 2024", "1.2.3", "2024-05", "2024-05-06", "10.1000/x", "NIST SP 800-53", "IEEE 802.11", "Regulation (EU) 2016/679", "5 Km", "5 kg"]
    rng = random.Random(3)
    for _ in range(500):
        text = rng.choice([" ", "\n", "; "]).join(rng.sample(signs, 5))
        low = detect.lowered(text)
        for rule, pattern, holds in detect._compiled():
            assert any(h in low for h in holds) or not pattern.search(text), (rule.sub, text)
    assert len(detect._compiled()) == len(RULES)


def test_grounded_as_by_one_pattern():
    one = lambda c: ("".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") or c)[0].lower()
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aÁb -_1.") for _ in range(n))
    for _ in range(2000):
        body, names = word(30), [word(rng.randint(1, 4)) for _ in range(4)]
        flat = "".join(map(one, body))
        plain = sorted({"".join(map(one, s.strip())) for s in names} - {""}, key=len, reverse=True)
        pattern = "|".join(rf"(?:(?<!\w)|(?<=\w)(?!\w)){re.escape(n)}(?:(?!\w)|(?<!\w))" for n in plain)
        assert detect.ground_spans(body, names) == ([m.span() for m in re.finditer(pattern, flat)] if plain else [])
