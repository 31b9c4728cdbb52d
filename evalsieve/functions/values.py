"""Fixed values that results depend on: word lists, phrases, patterns, thresholds."""

# Negation tokens and stop words of the shortcut rules.
NEGATION_WORDS = ["not", "never", "no", "none", "neither", "nor", "nothing", "nowhere"]
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can "
    "to of in for on with at by from as into through during and or but if then that this it its"
).split()

# Phrases and patterns of the contamination heuristics.
INDEX_FREE_PHRASES = ["according to the passage", "which of the following is", "in the context of", "based on the information", "the correct answer is"]
AUDIT_PHRASES = ["according to", "as stated in", "the following", "which of the following", "based on the", "in accordance with"]
TEMPLATE_PATTERNS = ["^which of the following", "what is the (primary|main|best|correct)", "in the year [0-9]{4}", "the (capital|president|ceo|founder) of", "___+ is defined as", "select the (best|most appropriate|correct)"]

# Terms of the paper filters and scores.
RELEVANCE_TERMS = ["benchmark", "evaluation", "contamination", "shortcut", "construct validity", "annotation artifact", "goodhart", "leakage", "data contamination", "benchmark gaming", "memorization", "item response theory"]
METHOD_STEMS = ["evaluat", "benchmark", "measur", "assess", "test", "metric", "performance", "accuracy", "contamin", "shortcut", "artifact", "bias", "generaliz", "robustness"]
FAILURE_STEMS = ["fail", "limitation", "problem", "issue", "bias", "shortcut", "artifact", "contamin", "overfit", "saturate", "incorrect", "mislead", "flawed", "invalid", "wrong"]
HIGH_VALUE_TERMS = ["contamination", "shortcut", "artifact", "benchmark critique", "evaluation failure", "spurious", "overfitting benchmark", "data leakage", "annotation artifact", "saturation"]
MEDIUM_VALUE_TERMS = ["evaluation", "benchmark", "assessment", "performance measurement", "metric", "leaderboard", "robustness", "generalization"]

# Subject words of mathematics problems, in order of precedence.
MATH_SUBJECTS = {
    "probability": ["probability", "expected value", "random"],
    "number_theory": ["prime", "divisible", "modulo", "integer", "digit"],
    "geometry": ["triangle", "circle", "area", "perimeter", "angle"],
    "sequences": ["sequence", "sum", "series", "term"],
    "algebra": ["polynomial", "equation", "roots", "function"],
    "combinatorics": ["combination", "permutation", "arrange", "choose"],
}

# Numbered problems of a wiki page; where a section ends decides which text is the problem's.
PROBLEM_SECTION = "(?is)==\\s*Problem\\s+(\\d+)\\s*==(.*?)(?===\\s*Problem\\s+\\d+\\s*==|==\\s*Solution|$)"

# Texts that planting adds to an item.
PLANT_PHRASES = ["According to widely available sources,", "As documented in standard references,", "The established consensus is that"]
PLANT_SUFFIX = " This is the correct and complete answer providing full detail and explanation."
PLANT_SEVERITY = {"ngram_overlap": 0.8, "template_fill": 0.7, "answer_leak": 0.9, "length_bias": 0.6, "position_bias": 0.5}

# Weights of composite scores.
CONTAMINATION_WEIGHTS = {"ngram": 0.4, "template": 0.3, "memorization": 0.3}
REWARD_WEIGHTS = {"shortcut": 0.5, "format": 0.3, "correlation": 0.2}

# Ids, categories and names of the failure patterns.
PATTERNS = [
    ("G01_length_bias", "surface", "Length Bias"),
    ("G02_lexical_overlap", "surface", "Lexical Overlap Shortcut"),
    ("G03_negation_artifact", "surface", "Negation Artifact"),
    ("G04_position_bias", "structural", "Answer Position Bias"),
    ("G05_ngram_contamination", "temporal", "N-gram Training Contamination"),
    ("G06_frequency_prior", "distributional", "Frequency Prior"),
    ("G07_semantic_collapse", "semantic", "Semantic Collapse of Distractors"),
    ("G08_distractor_implausibility", "semantic", "Implausible Distractor"),
    ("G09_template_fill", "structural", "Template Fill-in"),
    ("G10_annotation_agreement", "distributional", "Annotation Agreement Artifact"),
    ("G11_benchmark_saturation", "systemic", "Benchmark Saturation"),
    ("G12_measurement_drift", "temporal", "Measurement Drift"),
    ("G13_cherry_picking", "systemic", "Cherry-Picking"),
    ("G14_calibration_gaming", "distributional", "Calibration Gaming"),
    ("G15_contamination_paraphrase", "temporal", "Paraphrastic Contamination"),
    ("G16_metric_hacking", "structural", "Metric Hacking"),
    ("G17_context_length_shortcut", "surface", "Context Length Shortcut"),
    ("G18_format_memorization", "structural", "Format Memorization"),
    ("G19_distractor_generation_bias", "distributional", "Distractor Generation Bias"),
    ("G20_adversarial_blindspot", "semantic", "Adversarial Blind Spot"),
    ("G21_language_style_bias", "surface", "Language Style Bias"),
    ("G22_multihop_shortcut", "semantic", "Multi-hop Shortcut"),
    ("G23_evaluation_reward_hacking", "systemic", "Evaluation Reward Hacking"),
]
