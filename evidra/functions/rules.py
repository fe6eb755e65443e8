"""Word lists, patterns and weights that results depend on. They must stay as they are."""

# Information types, in the order in which their keywords are tried.
INFORMATION_TYPES = {
    "definition": ["define", "defined as", "refers to", "is a", "known as", "is the"],
    "statistic": ["%", "percent", "ratio", "average", "mean", "p-value", "p <", "p=", "standard deviation", "n ="],
    "methodology": ["method", "approach", "technique", "procedure", "algorithm", "we propose", "we use", "we employ"],
    "result": ["result", "found that", "showed", "demonstrated", "observed", "achieved", "accuracy", "performance"],
    "conclusion": ["conclude", "conclusion", "therefore", "thus", "hence", "in summary", "overall", "findings suggest"],
    "hypothesis": ["hypothes", "assume", "proposit", "conjecture", "research question"],
    "reference": ["et al", "doi:", "isbn", "journal", "[1]", "[2]", "cited", "references"],
    "equation": ["equation", "formula", "∑", "∫", "≥", "≤"],
    "enumeration": ["(i)", "(ii)", "(a)", "(b)", "firstly", "secondly"],
    "comparison": ["compare", "contrast", "versus", "while", "whereas", "outperform", "better than", "worse than"],
    "metadata": ["abstract", "keywords", "affiliation", "corresponding author", "received", "accepted"],
    "background": ["background", "related work", "previous", "prior work", "existing", "literature review"],
    "example": ["example", "for instance", "such as", "e.g.", "illustrat", "consider the"],
}
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
AFFILIATION = r"\b(?:University|Institute|School\s+of|Department\s+of|College|Laboratory|Research\s+(?:Center|Centre|Institute)|VIT|IIT|MIT|UCLA|IEEE|ACM)\b"
PROPER_NAME = r"^[A-Z][a-z]*\.?(?:\s+[A-Z][a-z]*\.?){1,4}\s*$"

# Weight of an information type in semantic density.
DENSITY_WEIGHTS = {
    "definition": 0.15, "statistic": 0.15, "result": 0.13, "methodology": 0.10, "conclusion": 0.13, "hypothesis": 0.10, "comparison": 0.08,
    "equation": 0.10, "fact": 0.05, "background": 0.03, "reference": 0.02, "metadata": 0.00, "enumeration": 0.05, "example": 0.05,
    "table_data": 0.10, "figure_description": 0.08,
}

TABLE_TYPES = {
    "performance_metrics": ["accuracy", "precision", "recall", "f1", "auc", "score"],
    "statistical_summary": ["mean", "std", "median", "average", "variance"],
    "literature_review": ["author", "year", "title", "journal", "reference"],
    "configuration": ["parameter", "setting", "value", "config", "hyperparameter"],
}
IMAGE_TYPES = {
    "chart": ["graph", "chart", "plot", "bar", "pie", "histogram", "line graph"],
    "diagram": ["diagram", "flowchart", "architecture", "pipeline", "workflow"],
    "equation": ["equation", "formula", "mathematical"],
    "screenshot": ["screenshot", "interface", "ui", "gui"],
    "photograph": ["photo", "photograph"],
}

# Claim rules: number, type, pattern, group, confidence.
CLAIM_PATTERNS = [
    (1, "entity_date", r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}", 1.0),
    (2, "entity_money", r"(?i)\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?|\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s?(?:USD|EUR|GBP|INR|RS|€|£)", 0.95),
    (3, "entity_statistic", r"\d+(?:\.\d+)?\s?%", 0.9),
    (4, "entity_duration", r"(?i)\d+\s+(?:day|week|month|year|hr|hour|min|minute)s?", 0.85),
    (7, "entity_contact", r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+", 1.0),
]
DEFINITION_CLAIM = r"""(?i)["']?([\p{L}\p{N}_\s]+)["']?\s+(?:means|is defined as|refers to)\s+([\p{L}\p{N}_\s,]+)"""
KEY_VALUE_CLAIM = r"^([\p{L}\p{N}_\s]+):\s+([^.]+?)$"
DEFINITION_GATE = r"(?i)(?:defined?\s+as|refers?\s+to|known\s+as|is\s+(?:a|an|the)\b)"
DEFINITION_TERM = r"""(?i)^["']?([\p{L}\p{N}_\s]{2,30}?)["']?\s+(?:is\s+(?:defined|a|an|the)|refers?\s+to|known\s+as)"""

# Question intents, in order; the rest is factual_lookup.
INTENTS = {
    "comparative": ["compare", "difference", "versus", "vs", "differ", "contrast"],
    "summarization": ["summarize", "summary", "overview", "brief", "describe overall"],
    "quantitative": ["how many", "what percentage", "what number", "how much", "count of"],
    "definition": ["what is", "define", "meaning of", "what does", "what are"],
    "causal": ["why", "reason", "cause", "because", "explain why"],
    "procedural": ["how does", "how do", "how is", "process", "method", "procedure", "steps"],
    "enumerative": ["list", "enumerate", "what are the", "name the", "which are"],
}
REASONING_INTENTS = ["comparative", "summarization", "causal"]
ANSWER_TYPES = {
    "number": ["how many", "how much", "what number", "count"],
    "percentage": ["percentage", "percent"],
    "date": ["when", "what date", "what year"],
    "name": ["who", "whose", "whom"],
    "definition": ["define", "definition", "what is a", "what are"],
    "list": ["list", "enumerate", "name the"],
    "explanation": ["why", "reason", "cause"],
    "yes_no": ["is it", "does it", "can it", "has it", "are there"],
}
ENTITY_STOP = [
    "what", "which", "how", "where", "when", "who", "why", "does", "do", "is", "are", "was", "were", "the", "a", "an", "of", "in", "on", "for", "to",
    "and", "or", "this", "that", "with", "from", "about", "can", "could", "would", "should", "will", "be", "been", "being", "have", "has", "had",
    "not", "it", "its", "they", "their", "them", "there", "describe", "explain", "tell", "me", "give", "find", "show",
]
EXPANSIONS = {
    "author": (["author of the document", "written by", "paper by", "contributed by"], ["author", "authors", "written", "writer", "contributor", "name", "by", "affiliation"]),
    "student": (
        ["student contributors", "students who made this project", "project built by students", "project team members"],
        ["student", "students", "team", "members", "contributors", "developers", "built by", "created by"],
    ),
    "team": (
        ["project team", "who made this project", "who built this project", "developers of this project"],
        ["team", "members", "developer", "developers", "creator", "contributors", "made", "built", "created"],
    ),
    "title": (["title of the document", "document name", "paper title"], ["title", "name", "heading", "subject", "topic"]),
    "date": (["publication date", "when was this published", "year of publication"], ["date", "published", "year", "issued", "received", "accepted", "submitted"]),
    "published": (["publication date", "when published", "date of publication"], ["published", "date", "year", "journal", "venue", "issued"]),
    "abstract": (["abstract of the paper", "paper summary", "document overview"], ["abstract", "summary", "overview", "introduction"]),
    "conclusion": (["conclusion of the paper", "main findings", "key results"], ["conclusion", "findings", "results", "summary", "outcome", "determined"]),
    "methodology": (["methodology used", "research method", "approach described"], ["method", "methodology", "approach", "technique", "procedure", "algorithm"]),
    "result": (
        ["research results", "findings of the study", "outcomes achieved"],
        ["result", "results", "finding", "findings", "outcome", "achieved", "performance", "accuracy"],
    ),
    "purpose": (["purpose of the document", "goal of the research", "objective"], ["purpose", "goal", "objective", "aim", "motivation", "research question"]),
    "reference": (["references cited", "bibliography", "cited works"], ["reference", "references", "bibliography", "cited", "citation"]),
}
METADATA_TRIGGERS = {
    "author": [
        "author", "authors", "written by", "by", "writer", "contributor", "creator", "created by", "developed by", "built by", "made by",
        "student", "students", "team", "developers", "project team",
    ],
    "title": ["title", "heading", "name of the document", "called"],
    "date": ["date", "published", "year", "when", "issued", "submitted", "received", "accepted"],
    "publisher": ["publisher", "journal", "publication", "venue", "conference", "press"],
    "affiliation": ["affiliation", "university", "institution", "department", "organization", "school"],
    "email": ["email", "e-mail", "contact", "mail"],
    "doi": ["doi", "identifier", "isbn", "issn"],
    "abstract": ["abstract", "summary", "overview"],
    "keyword": ["keyword", "keywords", "tags", "terms", "index terms"],
}
# What a line of each kind of metadata looks like.
METADATA_PATTERNS = {
    "author": [
        r"(?i)(?:author|authors|written\s+by|by|created\s+by|developed\s+by|built\s+by|made\s+by|team\s+members?)\s*[:\-–—]\s*(.+)",
        r"^([A-Z][a-z]*\.?(?:\s+[A-Z][a-z]*\.?){1,4})\s*$",
        r"(?i)^([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)*[A-Z][a-z]*\.?)",
        EMAIL,
        r"(?i)(?:University|Institute|Department|School|College|Laboratory|Research)\s+(?:of\s+)?[\p{L}\p{N}_\s,]+",
    ],
    "title": [r"(?i)(?:title)\s*[:\-–—]\s*(.+)"],
    "date": [
        r"(?i)(?:date|published|year|received|accepted|submitted)\s*[:\-–—]\s*(.+)",
        r"(?i)\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b",
        r"\b(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\b",
    ],
    "publisher": [r"(?i)(?:journal|publisher|published\s+(?:in|by)|venue|conference)\s*[:\-–—]\s*(.+)"],
    "affiliation": [
        r"(?i)(?:affiliation|department|university|institution|school)\s*[:\-–—]\s*(.+)",
        r"(?i)(?:University|Institute|Department|School|College|Laboratory)\s+(?:of\s+)?[\p{L}\p{N}_\s]+",
    ],
    "email": [EMAIL],
    "doi": [r"(?i)(?:doi|DOI)\s*[:\-–—]?\s*(10\.\S+)", r"10\.\d{4,}/\S+"],
    "abstract": [r"(?i)(?:abstract)\s*[:\-–—]\s*(.+)"],
    "keyword": [r"(?i)(?:keywords?|index\s+terms?|tags)\s*[:\-–—]\s*(.+)"],
}
# Words of a question that don't say what label it asks for.
HINT_STOP = [
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "for", "and", "or", "what", "who", "which", "where", "when", "this", "that", "does",
    "do", "did", "how", "by", "to", "with", "at",
]
RECALL_STOP = [
    "the", "a", "an", "is", "are", "was", "were", "of", "in", "for", "and", "or", "what", "who", "which", "where", "when", "this", "that", "does",
    "do", "did", "how", "by", "to", "with", "at", "on", "it", "be", "not", "from", "as", "but", "has", "have", "had", "can", "will", "would",
    "could", "should", "its", "so",
]

FACTUAL_START = r"(?i)^(who|what|which|when|where|whom|whose)\b"
FACTUAL_KEYWORDS = [
    "author", "name", "title", "date", "year", "founder", "creator", "publisher", "editor", "affiliation", "institution", "location", "city",
    "country", "number", "version",
]
METADATA_KEYWORDS = [
    "author", "authors", "writer", "written", "wrote", "student", "students", "team", "member", "members", "developer", "developers", "made",
    "built", "created", "developed", "title", "name", "heading", "date", "year", "published", "publication", "issued", "submitted", "received",
    "accepted", "publisher", "journal", "venue", "conference", "editor", "editors", "affiliation", "institution", "university", "department",
    "school", "college", "organization", "email", "contact", "doi", "isbn", "issn", "identifier", "abstract", "keywords", "subject", "version",
    "revision", "edition", "creator", "contributor", "owner", "document", "paper", "report", "manuscript", "article", "metadata", "details",
    "information about",
]
METADATA_PHRASES = [
    "who wrote", "who is the author", "who are the authors", "who made this project", "who built this project", "who created this project",
    "students who made this project", "student contributors", "project team", "what is the title", "when was this", "when was it",
    "where was this published", "what journal", "which journal", "document details", "document information", "document metadata",
    "paper details", "what year", "publication year",
]
AUTHORSHIP_KEYWORDS = [
    "author", "authors", "student", "students", "team", "developer", "developers", "creator", "creators", "contributor", "contributors", "member",
    "members",
]
AUTHORSHIP_PHRASES = [
    "who is the author", "who are the authors", "who made this project", "who built this project", "who created this project",
    "students who made this project", "student who made this project", "project team", "team members", "developed by", "built by", "created by",
]
NO_EVIDENCE = [
    "not found in the document", "no information found in the document", "does not contain", "not mentioned in the document",
    "no relevant information", "not available in the document", "is not provided", "unable to find", "could not find",
    "not present in the document", "no evidence found", "the document does not", "not discussed in the document", "cannot find",
    "couldn't find", "the provided evidence does not", "no information available", "the document doesn't contain",
    "based on the document, there is no", "insufficient document evidence",
]
REFUSALS = ["insufficient knowledge", "no information found", "i don't have", "not available", "does not contain", "no relevant information"]
ANSWER_STOP = [
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "to", "of", "in", "on", "with", "that", "this", "for", "it", "be", "has",
    "have", "had", "not", "as", "at", "by", "from", "can", "do", "does", "will", "would", "could", "should", "its", "their", "they", "we", "he",
    "she", "been", "about", "into", "also", "so", "very", "just", "there", "then", "these", "those", "some", "any",
]
CITATION_STOP = [
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "to", "of", "in", "on", "with", "which", "that", "this", "for", "it", "be",
    "has", "have", "had", "not", "as", "at", "by", "from", "can", "do", "does", "did", "will", "would", "could", "should", "may", "might", "its",
    "their", "they", "we", "he", "she", "been", "being", "about", "into", "through", "during", "before", "after", "between", "each", "all", "both",
    "such", "than", "also", "so", "only", "very", "just", "where", "when", "how", "what", "there", "then", "these", "those", "some", "any", "more",
    "most", "other",
]

SECTION_HEADERS = [r"(?i)^(MODULE|SECTION|CHAPTER|PART)\s+\d+", r"(?i)^\d+(\.\d+)*\s+[A-Z]", r"(?i)^[A-Z]{2,}(\s+[A-Z]{2,})*$", r"(?i)^Project:\s+.*", r"(?i)^Objective:?\s*.*"]
LIST_ITEMS = [r"(?i)^\s*[•‣◦⁃∙\-\*]\s+", r"(?i)^\s*\d+[\.\)]\s+", r"(?i)^\s*[a-zA-Z][\.\)]\s+", r"(?i)^\s*[ivxlcdm]+[\.\)]\s+"]
CAPTION = r"(?i)^(Figure|Fig\.|Table|Image|Diagram|Chart|Graph|Exhibit)\s+\d+"

EDGE_WEIGHTS = {
    "NEXT_LINE": 0.95, "CONTINUES_ON_PAGE": 0.93, "SEMANTICALLY_RELATED": 0.85, "SEMANTIC_ALIGNMENT": 0.82, "TOPIC_BRIDGE": 0.80,
    "DEFINITION_USED_IN": 0.78, "EVIDENCE_CHAIN": 0.75, "SECTION_SUMMARY_OF": 0.70, "PARAGRAPH_SUMMARY_OF": 0.70, "TABLE_CONTEXT": 0.72,
    "IMAGE_CONTEXT": 0.68, "THEME_MEMBER": 0.65,
}
SEARCH_POOL = {"summarization": 50, "comparative": 45, "enumerative": 45, "causal": 40, "definition": 35, "procedural": 35}
INTENT_BOOSTS = {
    "factual_lookup": {"definition": 0.12, "fact": 0.10, "statistic": 0.10, "result": 0.08},
    "comparative": {"comparison": 0.15, "result": 0.10, "statistic": 0.10, "table_data": 0.08},
    "summarization": {"conclusion": 0.12, "result": 0.10, "methodology": 0.08, "background": 0.06},
    "quantitative": {"statistic": 0.18, "result": 0.12, "table_data": 0.15, "fact": 0.08},
    "definition": {"definition": 0.18, "fact": 0.10, "background": 0.08},
    "causal": {"result": 0.12, "conclusion": 0.12, "methodology": 0.10, "fact": 0.08},
    "procedural": {"methodology": 0.18, "enumeration": 0.10, "fact": 0.08},
    "enumerative": {"enumeration": 0.15, "fact": 0.10, "table_data": 0.10},
}
ANSWER_BOOSTS = {
    "number": {"statistic": 0.10, "table_data": 0.10, "result": 0.06},
    "percentage": {"statistic": 0.12, "result": 0.08},
    "date": {"fact": 0.08, "metadata": 0.06},
    "definition": {"definition": 0.12, "background": 0.06},
    "list": {"enumeration": 0.12, "table_data": 0.08},
}
TOKEN_BUDGETS = {
    "summarization": 3200, "comparative": 2400, "procedural": 2400, "enumerative": 2000, "causal": 1800, "quantitative": 1600,
    "definition": 1400, "factual_lookup": 1024,
}
GROUNDING = {"merged": 0.95, "evidence_graph": 1.0, "llm_direct": 0.6, "deep_analysis": 0.92, "none": 0.0}
LABEL_SYNONYMS = {
    "author": ["author", "authors", "written", "writer", "writers", "by"],
    "wrote": ["author", "authors", "written", "writer", "by"],
    "written": ["author", "authors", "written", "writer", "by"],
    "writer": ["author", "authors", "writer", "writers", "by"],
    "title": ["title", "name", "heading", "subject"],
    "name": ["name", "title", "called", "named", "label"],
    "date": ["date", "published", "year", "issued", "received", "accepted", "submitted"],
    "year": ["date", "year", "published", "issued"],
    "published": ["date", "published", "publication", "year", "issued"],
    "publisher": ["publisher", "published", "publication", "press", "journal"],
    "journal": ["journal", "publisher", "publication", "published"],
    "editor": ["editor", "editors", "edited"],
    "affiliation": ["affiliation", "affiliations", "institution", "university", "department", "school", "college", "organization"],
    "institution": ["institution", "university", "affiliation", "department", "school", "college", "organization"],
    "university": ["university", "institution", "affiliation", "school", "college"],
    "location": ["location", "city", "country", "address", "place"],
    "city": ["city", "location", "place", "address"],
    "country": ["country", "location", "nation"],
    "email": ["email", "mail", "contact", "e-mail"],
    "doi": ["doi", "identifier", "id"],
    "abstract": ["abstract", "summary", "overview"],
    "keyword": ["keyword", "keywords", "tags", "terms"],
    "version": ["version", "release", "revision"],
    "founder": ["founder", "founded", "creator", "established"],
    "creator": ["creator", "created", "founder", "author"],
}
THEMES = {
    "Introduction & Background": (["introduction", "background", "overview", "related work", "literature"], ["introduction", "background", "overview", "context", "motivation", "prior work"]),
    "Methodology & Approach": (
        ["method", "approach", "technique", "procedure", "algorithm", "design", "implementation"],
        ["method", "approach", "technique", "algorithm", "design", "procedure", "framework"],
    ),
    "Results & Findings": (
        ["result", "finding", "experiment", "evaluation", "performance", "analysis"],
        ["result", "finding", "performance", "accuracy", "experiment", "evaluation", "outcome"],
    ),
    "Conclusion & Discussion": (["conclusion", "discussion", "summary", "future work", "limitation"], ["conclusion", "discussion", "summary", "future", "limitation", "implication"]),
}
METADATA_THEME = [
    "author", "title", "date", "published", "journal", "affiliation", "university", "email", "doi", "abstract", "keywords", "institution",
    "department", "corresponding", "editor", "volume", "issue",
]

# Words that speak of who made a document.
AUTHORSHIP_TERMS = ["author", "authors", "written by", "created by", "built by", "developed by", "team", "student", "students", "contributor", "developer", "project"]
FACT_STOP = [
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "to", "of", "in", "on", "with", "which", "that", "this", "for", "it", "be",
    "has", "have", "had", "not", "as", "at", "by", "from",
]

# Questions that are suggested without a model, and where its reply holds none.
SUGGESTED_WITHOUT_MODEL = ["What is this document about?", "Key takeaways?", "Main conclusions?"]
SUGGESTED_WITHOUT_REPLY = [
    "What is the primary objective of this document?", "What are the key results or findings?", "Who authored this document?",
    "What methodology was used?",
]
# What an encoder is told before a question, a passage, a picture's description and a table.
ENCODER_TASKS = {
    "query": "Represent this query for retrieving relevant document content: ", "passage": "Represent this document passage for retrieval: ",
    "image": "Represent this image description for retrieval: ", "table": "Represent this table for retrieval: ",
}
