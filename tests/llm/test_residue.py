from __future__ import annotations

import time

import pytest

from strandwork.llm.residue import ResidueIndex, detect_residue, exemplars, stem, without_residue

LEAD = "The plan covers three work packages on sleep duration, asthma and stroke. "
RESIDUE = [
    "Dear {{ pi_name }}, thank you.", "Dear {applicant},", "Held by <<institution>> since", "Approved by [Your funder here].", "See <insert project id>.", "At &lt;start date&gt; it begins", "By @@repo_owner@@ and",
    "The #pi_name# said", "For %CONTACT_NAME% only", "For __PROJECT_ID__ only", "By $APPLICANT and", "By ${funder} and", "In [[summary]] we", "In {% summary %} we", "By [PI NAME] on", "Funding: ____________.", "Funding: XXXXXX.", "At (institution to be inserted) we",
    "研究代表者は{applicant}である。", "Dolor magna lorem placeat sit amet tempor aliqua commodo fugiat cillum veniam ipsum.", "Sample text. Sample text. Sample text. Sample text.", "Please enable JavaScript to view this page.",
    "Loading... Loading... Loading...", "Fehler 404: Die angeforderte Seite wurde nicht gefunden.", "お探しのページは見つかりませんでした。", '{"error": {"status": 403, "message": "resource not available"}}', "503 - page not available\n\nThe page you asked for could not be found. Return to the home page or use the search.",
    "SERVICE IS TEMPORARILY DOWN FOR\nMAINTENANCE. PLEASE TRY AGAIN IN A FEW MINUTES.", "Insert lay summary here.",
]
WHOLE_ONLY = ["TBD", "placeholder", "<html><head><title>Untitled</title></head><body><div>TBD</div></body></html>", "[2023-03-01 14:53] TBD", "Coming soon"]
NONE = [
    "The report template uses Jinja, e.g. `{{ title }}`, and is filled by make_report.py.", "Column names in [SQUARE BRACKETS] follow the field catalogue.", "Set the path with `export DATA_DIR=${HOME}/cohort` before the first run.",
    '```python\nprint(f"{app_id}: {n_rows} rows")\n```', 'print(f"{app_id}: {n_rows} rows")', r"The formula is $\hat{\beta} = (X^{T}X)^{-1}X^{T}y$ with robust errors.", "The word placeholder here means an inert tablet given to the control arm.", "The date is TBD by the board.",
    "Forms in which respondents had typed filler such as lorem ipsum were dropped before coding.", "Access denied messages in the audit log were counted per week as an outcome.", "A page not found by the crawler was counted as removed.", "Users had to enable cookies to take the cognitive test.",
    "We wrote the front end in JavaScript; the charts need scripts, but the tables are plain text and can be read without them.", "Our server returned error 503 twice during the survey.", "Values coded XXX in the source file stand for a withdrawn consent.", "Title\n____\n\nBody", "a[1] and <b>x</b> and #tag and 5% of 10%", "", "   ", None,
]

# hand-written; none of them is an exemplar, and the second lot only speaks of such things
UNSEEN = """This service is currently unavailable; please contact the administrator.
Error 410: the resource has been permanently removed.
Sorry, we could not find the page you were looking for.
The page you were trying to reach is no longer available.
You must enable cookies in your browser to continue.
JavaScript is required to view this site. Please turn it on and reload.
It looks like JavaScript is switched off in your browser.
Please wait while we check your browser.
Please verify that you are human before you continue.
Your request could not be completed because of a server error.
Our server is down for scheduled maintenance. Please try again later.
You have made too many requests. Please try again in a few minutes.
You do not have permission to access this project.
This account has been disabled.
This repository is no longer available.
The connection to the server timed out.
Gateway timeout: the server did not respond in time.
An error occurred while loading this page. Please reload the page.
Your session timed out. Please log in again.
You need to sign in before you can view this project.
Please insert your abstract here.
Replace this sample text with your own summary.
Enter a short summary of your project here.
Your description goes here.
This is placeholder text, please replace it.
This page is still under construction, please check back soon.
sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris
Dear [Recipient], thank you.
Signed by {{ signatory_title }} on the day.""".splitlines()
SPEAKS = """The server returned an error in two of the forty runs, which we repeated.
Participants who did not enable cookies could not take the online test.
We counted how often a page was not found during the crawl.
Access to the data was denied to three applicants in 2019.
The site was down for maintenance on the day of the second wave.
Loading of the second factor was low in women.
The placeholder group received tablets without the active substance.
Filler text such as lorem ipsum was removed before coding.
Scripts for the analysis are available on request.
Our web form asks for JavaScript, but a paper version was sent to those without it.
The session expired for nine participants, who were invited again.
We tried again later with a smaller learning rate.
Too many requests for samples were received in the first year.
Some repositories have been disabled since the first notice.
The browser history was not available to the study team.
The captcha was solved by all but two participants.
Please note that the sample was small and the results are to be confirmed.
Time-outs at the gateway were logged as missing values.
The requested samples could not be found in the freezer.
A description of the project is given in the protocol.
The template has a field for the name of the applicant.
The database could not be reached from outside the hospital.
Each participant had to sign in at the reception of the clinic.
Enter the ward only with a mask, as the sign on the door says.
The puzzle task shows how well a person plans.
Details of the maintenance of the scanner are given below.
Unauthorised use of the data is a breach of the agreement.
The test text had eight hundred words and two tables.
We were sorry to find that something went wrong with the third batch.
Error bars show the standard error of the mean over 10 runs.""".splitlines()


@pytest.fixture(scope="module")
def index():
    known = exemplars()
    frequency = {t: 400 if t in ("the", "of", "and", "a", "to", "in", "this", "is", "for", "page", "be", "not") else 3 for x in known for t in x.terms}
    return ResidueIndex(known, frequency, 1000)


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_alone_and_in_one_place(index, text):
    assert index.judge(text)
    assert index.judge(LEAD + text + " " + LEAD)


@pytest.mark.parametrize("text", WHOLE_ONLY)
def test_words_that_are_residue_alone(index, text):
    assert index.judge(text) and index.judge(LEAD + "\n\n" + text)


@pytest.mark.parametrize("text", NONE)
def test_texts_that_speak_of_it(index, text):
    assert index.judge(text) is None
    assert text is None or index.judge(LEAD + text) is None


def test_unseen_notices_and_texts_that_speak_of_them(index):
    known = {e.text for e in exemplars()}
    assert len(UNSEEN) == len(SPEAKS) == 30 and not known & {*UNSEEN}
    assert sum(index.judge(f"{LEAD}{t} {LEAD}") is not None for t in UNSEEN) >= 28
    assert sum(index.judge(f"{LEAD}{t} {LEAD}") is not None for t in SPEAKS) <= 3


COMMON_HERE = {stem(w) for w in "error page server access site request project content text data time please first test browser start order show may take reach long".split()}


def test_each_exemplar_is_found_by_the_others(index):
    """Those of a few words can only be found as they are; of the others nine in ten are."""
    known = exemplars()
    asked = [x for x in known if x.kind != "slot" and len(set(x.terms)) > 3]
    often = "the of and a to in is this for be not you your it on or that we are was by from with has have an as at our can no will more".split()
    frequency = {t: 5000 if t in often else 300 if t in COMMON_HERE else 5 for x in known for t in x.terms} | dict.fromkeys(often, 5000)
    found = [ResidueIndex([y for y in known if y is not x], frequency, 10_000).judge(x.text) for x in asked]
    assert sum(f is not None for f in found) >= 0.9 * len(asked)
    assert any(f[2] < 0.999 for f in found if f)


def test_slots_are_judged_by_their_delimiters_and_names():
    known = exemplars()
    rare, usual = (ResidueIndex(known, {"\x00[]": n, "in": 5_000, "and": 5_000}, 10_000) for n in (3, 2_000))
    assert rare.judge("Held by [your institution] and") and usual.judge("Held by [your institution] and")
    assert rare.judge("Seen in [brackets galore shown] and") is None and usual.judge("As in [12] and [brackets]") is None


@pytest.mark.parametrize("text", ["Geführt von &lt;applicant&gt; seit", "研究代表者は____________である。", "研究代表者は$PI_NAMEである。", "所属：&lt;institution&gt;。", "Insert\nlay summary here."])
def test_slots_beside_other_scripts_and_wrapped_lines(index, text):
    assert index.judge(text) and index.judge(f"{LEAD}\n\n{text}\n\n{LEAD}")


def test_no_bounds(index):
    far = "x" * 5000
    assert index.judge(f"<code>{far} {{{{ title }}}}</code> ok") is None and index.judge(f"`{far} {{{{ title }}}}` ok") is None
    assert index.judge(f'<img src="{far}"> Please enable JavaScript to view this page.')
    assert index.judge(f"<script>{far * 6} Please enable JavaScript to view this page.</script> ok") is None
    assert index.judge("Dear {{ " + "name " * 40 + "}},")


def test_long_odd_texts_take_no_longer_than_long_plain_ones(index):
    began = time.perf_counter()
    for part in ("<code>", "$\\\\a ", "f\"", "{{ a", "(a b ", "[AB ", "`", "<script>", "&lt;a ", "____ ", "lorem ", "## | ", "'r "):
        index.judge(part * 40_000)
    assert time.perf_counter() - began < 60


def test_tables(spark):
    rows = [(1, "Dear {{ pi_name }},", "k"), (2, LEAD, "k"), (3, None, "k"), (4, "", "k"), (5, LEAD * 3000 + "Funding: XXXXXX.", "k"), (1, "Dear {{ pi_name }},", "k"), (None, "x", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted(r["doc_id"] for r in detect_residue(df).collect()) == [1, 1, 5]
    assert sorted(str(r["doc_id"]) for r in without_residue(df).collect()) == ["2", "3", "4", "None"]
    assert detect_residue(df.limit(0)).count() == 0
