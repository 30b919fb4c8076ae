import re

import pytest
from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st

from lakelens.llm import residue as R
from lakelens.session import stage_table

SCHEMA = "doc_id long, text string, source string, doc_kind string, path string, message string, kind int"


def kinds(text):
    return {k for s in R.segments(R.without_code(text)) for k in [R.classify(s)] if k and k != "vague"}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("# {{ title }}", "template"), ("Owner is [[module]].", "template"), ("Release ${summary}", "template"), ("<TEAM NAME>", "template"), ("Dear <ON CALL>,", "template"), ("Placeholder paragraph number 4.", "filler"), ("Contact the [INSERT LICENSE HERE] team.", "template"), ("- step one: %(description)s", "template"),
        ("(describe the change)", "template"), ("[Explain the problem in two or three sentences]", "template"), ("Write a short summary of the change here.", "template"), ("<your due date here>", "template"), ("@@VERSION@@", "template"),
        ("Lorem ipsum dolor sit amet", "filler"), ("Text text text text text text.", "filler"), ("Your content goes here. Your content goes here.", "template"),
        ("<html><head><title>429 Too Many Requests</title></head></html>", "error"), ('{"message": "503 Service Unavailable", "request": "a4"}', "error"), ("Page introuvable (erreur 504). Référence 06467b93", "error"), ("504 Gateway Timeout", "error"),
        ("Access denied. You do not have permission to view x on this server.", "error"), ("Half a sentence\n\n-- content unavailable: 502 Bad Gateway --", "error"), ("Sign in to continue to harbor. Your session has expired.", "error"), ("fatal: could not read from remote repository x, access refused", "error"),
        ("You need to enable JavaScript to run this app.", "script"), ("Bitte aktivieren Sie JavaScript, um x anzuzeigen.", "script"), ("<noscript>Scripts are switched off, so x cannot be shown.</noscript>", "script"), ("Unable to display the remaining content because scripts are blocked in this browser.", "script"),
    ],
)
def test_residue(text, kind):
    assert kind in kinds(text)
    assert kind in kinds("# A title\n\nA paragraph of the author.\n\n" + text)


@pytest.mark.parametrize(
    "text",
    [
        "Write `{{ name }}` where the renderer should put the value.", "```\n# ${author}\n<OWNER>\n```\nThe title is filled from the template above.", "TODO: publish the font once `x` is merged.", "The lorem text in the fixtures of `x` hides a real bug.",
        "A 503 Service Unavailable from the batch is retried 6 times, then `x` gives up.", 'Users of the quarry saw "access denied" 6 times because `x` used an old session.', "We dropped JavaScript from the page in version 5.2.", "The dashboard needs JavaScript only for the totals; `x` works without it.",
        "When the host answers 403, `x` logs the path and goes on.", "Since Monday the palette sends 404 Not Found for 2 paths that `x` still lists.", "`x` rejects placeholder titles before the cursor is written.", "See [the guide](docs/guide.md) and [x] done.", "Map<String> and List<T> are fine.", "",
    ],
)
def test_no_residue(text):
    assert kinds(text) == set()


@pytest.mark.parametrize("day", ["monday", "tuesday", "the last release"])
def test_reports_of_any_time_are_no_residue(day):
    assert kinds(f"The page could not be loaded since {day}.") == set() and kinds(f"Since {day} 2 paths that `x` lists answer 404 Not Found.") == set()
    assert kinds("The page could not be loaded.") == {"error"} and kinds("Rate limit reached for x_y; retry after 30 seconds.") == {"error"}


def test_filler_of_unknown_words():
    assert kinds("Ipsum morvane kelto drassi lorem quenta velmo") == {"filler"} and kinds("Morvane ipsum kelto drassi quenta velmo") == {"filler"}
    assert kinds("The lorem text is in the fixture of the page.") == set() and kinds("Morvane kelto drassi quenta velmo sandri") == set()


def test_groups_are_counted_before_they_are_classified(spark):
    rows = [(n, f"Fault {n}: sign in again for item {n}", f"s{n % 4}", None, None) for n in range(8)] + [(20, "Fault: log in for a thing", "s1", None, None), (21, "The quay is open", "s2", None, None)]
    found = R.messages(spark.createDataFrame([(*r, "m", 1) for r in rows], SCHEMA))
    assert {r.doc_id for r in found.collect()} == {*range(8), 20} and len({r.message for r in found.collect()}) == 2
    verdicts = R.judged(found).collect()
    assert len(verdicts) == 8 and {(r.kind, r.sources) for r in verdicts} == {("vague", 4)}
    assert R.judged(found, wide=5).count() == 0


def test_masking_groups_the_same_message():
    a = R.masked("Reference 9f3ab2c1 at 2024-03-01 12:30 from 10.0.0.1, see https://x.example/a")
    b = R.masked("Reference 00ff1e22 at 2023-11-30 01:05 from 192.168.7.9, see https://y.example/b")
    assert a == b


def test_operator(spark):
    vague = "Status 504 for harbor, error class 7."
    rows = [(1, "# {{ title }}", "a", "readme", None), (2, None, "a", None, None), (3, "", "a", None, None), (4, "# {{ title }}", "a", "source", None), (5, "# ${x}", None, None, "a/b.py"), (6, "word " * 80_000 + "\n504 Gateway Timeout", None, None, None), (6, "504 Gateway Timeout", None, None, None), (None, "{{ x }}", "a", None, None)]
    rows += [(10 + n, vague.replace("504", str(500 + n)), f"s{n % 2}", None, None) for n in range(6)]
    rows += [(20 + n, f"Erreur {n}: fiche {n}", f"s{n}", None, None) for n in range(4)]
    df = spark.createDataFrame([(*r, "m", 1) for r in rows], SCHEMA)
    got = {r.doc_id: r for r in R.residue(df, stage_table).collect()}
    assert got.keys() == {1, 6, 20, 21, 22, 23}
    assert got[1].kinds == "template" and got[6].kinds == "error,filler" and got[20].widest == 4
    assert R.residue(df.limit(0), stage_table).count() == 0


def test_fast_path_sees_every_line_that_rules_match():
    texts = ["a\n{{ x }}\nb", "a\n<OWNER>\nb", "a\n[ABC]\n", "x\nİ {{ x }}\ny", "p\nword word word word word\nq", "[List them]", "  - (describe the change)"]
    for text in texts:
        assert kinds(text), text


@pytest.mark.parametrize("line", ["Connection reset by peer", "Sample paragraph 2", "Example text", "Sample heading", "1. [Describe the change]", "| [Describe the change] |", "See <choose a person> for this", "(choose a colour)", "Ask <type a name> first"])
def test_lines_that_only_a_rule_knows(line):
    assert kinds(line) and kinds(f"# A title\n\n{line}\n\nThe end")


RULES = [a for rule in (R._FIELD, R._PROMPT, R._BLANKS, R._FILLER, R._SERVER, R._SCRIPTS, R._VAGUE) for a in R.alternatives(rule.pattern)]


@pytest.mark.parametrize("alternative", RULES)
def test_every_alternative_passes_the_prefilter(alternative):
    rule = re.compile(alternative if alternative.startswith("(?i)") or alternative in R.alternatives(R._FIELD.pattern) else f"(?i){alternative}")

    @settings(max_examples=12, deadline=None, derandomize=True, database=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(rule) if "(?=" not in alternative else st.sampled_from([f'{{"{key}" : "x failed"' for key in ("error", "message", "detail", "title", "fault", "status", "code")]))
    def passes(line):
        assume("\n" not in line and rule.search(line.strip()))
        assert line in list(R._lines(f"x\n{line}\nx"))

    passes()


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("<!doctype html><html><head><style>" + "a{color:#123456;margin:0} " * 60 + "</style><title>403 Forbidden</title></head><body><p>We log each visit. Our team looks at it because x.</p></body></html>", "error"),
        ("<html><head><style>" + "a{color:#123456;margin:0}" * 60 + "</style></head><body><div>Access denied</div></body></html>", "error"),
        ("<html><head><style>" + "a{color:#123456;margin:0}" * 60 + "</style></head><body><noscript>Scripts are off here.</noscript></body></html>", "script"),
        ('{"error": "it went on. And on", "trace": "' + "at x.y.z; " * 80 + '", "status": 503}', "error"),
        ("Please " + "and once more " * 60 + "enable JavaScript to run this app.", "script"),
    ],
)
def test_long_lines_are_classified(text, kind):
    assert len(text) > 600 and kind in kinds(text)


def test_long_vague_messages_count():
    assert R.classify("An error of the harbour " + "and of the quay " * 20) == "vague"
