import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import contentstats as cs
from corpusloom.functions import identifiers as idn
from corpusloom.functions import imports as imp
from corpusloom.functions import links as lnk
from corpusloom.functions import textclean as txt


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("r")).first().r


@pytest.mark.parametrize("raw", ["Harbour", "K+L", "k-l", "North  Quay, Outer (1901)", "Red/Blue"])
def test_identifiers(spark, raw):
    canonical = raw.strip().lower().replace(" ", "_")
    bare = re.sub("__+", "_", re.sub(r"[^a-z0-9_\-]", "_", canonical)).strip("_")
    want = f"{bare}_{hashlib.md5(canonical.encode()).hexdigest()[:6]}"
    assert one(spark, idn.normalize_identifier("x"), x=raw) == want == idn.python_normalize_identifier(raw)


def test_other_identifiers(spark):
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()[:6]
    assert one(spark, idn.normalize_repository("x"), x="Port/tug-boat") == "port_tug_boat_" + digest("port_tug_boat")
    assert one(spark, idn.generation_identifier("x"), x="K+L m") == "kl_m_" + digest("K+L m")
    assert one(spark, idn.strip_hash("x"), x="tug_a7f5f3") == "tug"
    assert one(spark, idn.module_of_path("x"), x="dock/crane.py") == "dock.crane"
    assert one(spark, idn.span_key("x", "python"), x="port:dock/crane.py") == "dock/crane.py"
    assert one(spark, idn.det_hash32("x"), x="ab") == ord("a") * 131 + ord("b")
    assert one(spark, idn.normalize_identifier("x", unescape=True), x="K&amp;L") == "k_l_" + digest("k&l")
    assert one(spark, idn.extension("x"), x="dock/b.TXT") == ".txt" and one(spark, idn.extension("x"), x="dock/Makefile") == "<none>"


def test_links_and_imports(spark):
    body = "See [the pier](Old%20Pier) or [quay](n+s) ![img](z) [c!](no)."
    assert one(spark, F.array_join(lnk.link_targets(F.col("x")), "|"), x=body) == "Old Pier|n+s|z"
    code = "import re, zlib\nfrom dock.crane import (\n    hook,  # note\n    chain,\n)\nfrom . import x\nimport a.b as c\nfrom m import *\n"
    pairs = one(spark, F.transform(imp.parsed_imports(F.col("x")), lambda p: F.concat_ws(":", p["module"], p["name"])), x=code)
    assert set(pairs) == {"re:", "zlib:", "dock.crane:hook", "dock.crane:chain", "a.b:", "m:*"}
    assert one(spark, imp.candidate_paths(F.lit("dock.crane"), F.lit("hook")), x="") == ["dock/crane/hook.py", "dock/crane/hook/__init__.py", "dock/crane.py", "dock/crane/__init__.py"]
    assert set(one(spark, imp.file_imports(F.col("x")), x="import os\nimport mine\nfrom .rel import q\n")) == {"mine", ".rel"}


def test_content_signature(spark):
    long = " " * 5000
    assert one(spark, cs.content_signature(F.col("x")), x=long + "a") == one(spark, cs.content_signature(F.col("x")), x=long + "b")
    assert one(spark, cs.content_signature(F.col("x")), x="p \n\tq ") == hashlib.md5(b"p q").hexdigest() != one(spark, cs.content_signature(F.col("x")), x="p q r")
    assert one(spark, cs.content_signature(F.col("x")), x="") == ""


def test_statistics(spark):
    assert one(spark, cs.line_lengths(F.col("x")), x="ab\r\nc\n") == [2, 1]
    assert one(spark, cs.line_lengths(F.col("x")), x="") == []
    assert [one(spark, cs.pow2_label(F.lit(n)), x="") for n in (0, 1, 2, 3, 4, 1023)] == ["0", "1-1", "2-3", "2-3", "4-7", "512-1023"]
    assert [one(spark, cs.edge_bucket(F.lit(n), [2, 4, 8, 16]), x="") for n in (1, 2, 3, 4, 7, 8, 16, 100)] == [0, 1, 1, 2, 2, 3, 4, 4]


def test_cleaning_steps():
    assert txt.drop_nested("p {{q {{r}} s}} t", "{{", "}}") == "p  t"
    assert txt.drop_nested("p }} {{q}} t", "{{", "}}") == "p }} {{q}} t"
    assert txt.internal_links("[[harbour]]s [[North Quay|quay]] [[File:map.png|m]] [[:Image:buoy.jpg|Buoy]] [[wikt:keel]]") == "[harbour](harbour)s [quay](North Quay)  Buoy [keel](keel)"
    assert txt._run("broken_links")("The [[Keel] of it.") == "The [Keel] of it."
    assert txt._run("number_templates")("Draught {{val|4.5}} m") == "Draught 4.5 m"
    assert txt._run("reference_tags")("It sank<ref name='log' />. Twice") == "It sank. Twice" and txt._run("reference_tags")("Twice.<ref>log</ref>") == "Twice."
    assert txt.html_lists("<ol><li>bow</li><li class='k'>stern<li> </ol>") == "- bow\n- stern"
    assert txt.html_quotes("x<blockquote cite=y> one \n\n two</blockquote>z") == "x\n> one\n> two\nz"
    assert txt.sections("lead\n== Notes ==\nn\n== Hull ==\nsteel \n\n=== Empty ===\n \n== Deck ==\nwood") == "lead\n\n## Hull\nsteel\n\n## Deck\nwood"
    # uneven marks open a section that shares the fate of the one before
    assert txt.sections("== Notes ==\nn\n == Aft ==\nx\n== Hull ==\nsteel\n == Rib ==\noak") == "## Hull\nsteel\n\n== Rib ==\noak"
    assert txt.leftover_mediawiki_links("[[Image:deck [[plan]] a]]z") == "z"
    assert txt.clean_text("") == ""


@pytest.mark.parametrize(("raw", "want"), [("\n\nk\n\n\n \n\nm\n\n", "k\n\n\nm"), (" \n\t", ""), ("  k\n\n\nm  ", "  k\n\n\nm  "), ("k\n \n\t\n\nm", "k\n \n\t\nm"), ("", "")])
def test_blank_lines(spark, raw, want):
    assert txt._run("blank_lines")(raw) == want == one(spark, txt.step("blank_lines", F.col("x")), x=raw)


def test_steps_agree_between_column_and_python(spark):
    text = "''low'' '''high''' * x\n* tide\n; Ebb\nFile:chart.png\n<sup>3</sup> ****x** ***w*** (18401902) [http://sea.example/p q]"
    for name in txt.STEPS:
        assert one(spark, txt.step(name, F.col("x")), x=text) == txt._run(name)(text), name


def test_clean_wikitext_handles_null(spark):
    assert one(spark, txt.clean_wikitext("x"), x=None) is None
