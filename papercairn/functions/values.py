"""Fixed values of the rules on headings and abstracts: each must be as it is for results to match."""

# A heading, and the type of section it stands for ("back" is back matter)
SECTION_ROWS = """
abstract, abstract
summary of the article, abstract
background, intro
introduction, intro
epidemiology, intro
rationale, intro
objective, intro
objectives, intro
aim, intro
aims, intro
purpose, intro
method, methods
methods, methods
materials, methods
material and methods, methods
materials and methods, methods
patients and methods, methods
subjects and methods, methods
study design, methods
study population, methods
study sample, methods
study subjects, methods
study selection, methods
subjects, methods
patients, methods
participants, methods
animals, methods
statistical analysis, methods
statistical analyses, methods
statistical methods, methods
statistics, methods
data source, methods
data sources, methods
data collection, methods
data extraction, methods
data analysis, methods
data availability, methods
search strategy, methods
search methods, methods
literature search, methods
literature review, methods
eligibility criteria, methods
inclusion criteria, methods
exclusion criteria, methods
covariates, methods
confounding variables, methods
outcome of interest, methods
outcome measures, methods
measures, methods
assessment, methods
clinical assessment, methods
quality assessment, methods
risk of bias, methods
ethics, methods
ethics statement, methods
ethical approval, methods
irb approval status, methods
sample size, methods
randomization, methods
intervention, methods
interventions, methods
procedure, methods
procedures, methods
protocol, methods
treatment protocol, methods
definitions, methods
consensus process, methods
result, results
results, results
findings, results
outcomes, results
adverse events, results
safety, results
efficacy, results
treatment response, results
subgroup analysis, results
subgroup analyses, results
sensitivity analysis, results
sensitivity analyses, results
search results, results
study characteristics, results
baseline characteristics, results
patient characteristics, results
characteristics of the study population, results
description of included studies, results
included studies, results
data synthesis, results
effect of interventions, results
case, results
case report, results
case presentation, results
case description, results
case series, results
case summary, results
clinical course, results
clinical findings, results
clinical studies, results
histopathology, results
pathology, results
animal study, results
animal studies, results
discussion, discussion
conclusion, discussion
conclusions, discussion
limitations, discussion
strengths and limitations, discussion
comment, discussion
clinical implications, discussion
implications, discussion
future directions, discussion
interpretation, discussion
significance, discussion
mechanism of action, discussion
pathogenesis, discussion
concluding remarks, discussion
outlook, discussion
management, discussion
acknowledgment, back
acknowledgments, back
acknowledgement, back
acknowledgements, back
conflict of interest, back
conflicts of interest, back
competing interests, back
disclosure, back
disclosures, back
funding, back
funding sources, back
financial support, back
author contributions, back
authorship, back
contributors, back
data availability statement, back
supporting information, back
supplementary material, back
supplementary materials, back
abbreviations, back
orcid, back
references, back
bibliography, back
appendix, back
associated data, back
ethics approval and consent to participate, back
"""
# A last word of a heading, and the type it stands for
LAST_WORD_ROWS = """
methods, methods
method, methods
methodology, methods
results, results
result, results
findings, results
discussion, discussion
conclusion, discussion
conclusions, discussion
introduction, intro
background, intro
abstract, abstract
"""
# How running headers and footers begin that stand where a heading would
JUNK_BEGINNINGS = ("0123456789", "capsule summary", "j am acad dermatol", "downloaded from", "downloaded for", "see related", "this article is protected", "copyright", "license", "licence")
# Labels of the parts of an abstract
ABSTRACT_LABELS = ("result", "results", "conclusion", "conclusions", "background", "objective", "objectives", "method", "methods", "limitation", "limitations", "importance", "finding", "findings", "meaning")
# Second and first parts of compounds that keep their hyphen, and the length beyond which a second part is a word
HYPHEN_TAILS = "and or nor to but with without versus vs than then plus related associated based induced free like dependent independent specific negative positive matched mediated controlled resistant naive term type level dose sparing old linked blind only wide rich poor driven derived guided treated exposed".split()
HYPHEN_HEADS = "self non pre post anti co mid sub well long short high low single double open case cross follow first second third one two three multi semi intra inter trans re de over under new old full half whole time site dose sex gender age race year week month day drug skin sun body risk".split()
HYPHEN_TAIL = 7
# Words before a journal's name that call for it
BEFORE_JOURNAL = "the in of to from by for at on with our this that a an and or journal published appear appears appeared see cited citing via".split()


def rows(text: str) -> list[tuple[str, str]]:
    """The rows of one of the tables above."""
    return [tuple(r.rsplit(", ", 1)) for r in text.strip().splitlines()]
