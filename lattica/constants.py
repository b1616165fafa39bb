"""Fixed values of the data model: they must equal the values the results are defined by."""

ENTITY_TYPES = ["Paper", "Author", "Institution", "Method", "Task", "Dataset", "Model", "Metric", "Result", "Domain"]
RELATION_TYPES = ["PROPOSES", "USES", "EVALUATED_ON", "OUTPERFORMS", "ACHIEVES", "BELONGS_TO", "EXTENDS", "COMPARED_WITH", "EVALUATED_BY", "AUTHORED_BY"]
RELATION_VARIANTS = {
    "PROPOSES_METHOD": "PROPOSES",
    "PROPOSES_MODEL": "PROPOSES",
    "PROPOSES_APPROACH": "PROPOSES",
    "PROPOSES_FRAMEWORK": "PROPOSES",
    "USES_DATASET": "USES",
    "USES_METHOD": "USES",
    "USES_MODEL": "USES",
    "EVALUATED_ON_DATASET": "EVALUATED_ON",
    "EVALUATED_ON_BENCHMARK": "EVALUATED_ON",
    "OUTPERFORMS_MODEL": "OUTPERFORMS",
    "OUTPERFORMS_METHOD": "OUTPERFORMS",
    "OUTPERFORMS_BASELINE": "OUTPERFORMS",
    "ACHIEVES_RESULT": "ACHIEVES",
    "ACHIEVES_PERFORMANCE": "ACHIEVES",
    "BELONGS_TO_INSTITUTION": "BELONGS_TO",
    "BELONGS_TO_DOMAIN": "BELONGS_TO",
    "EXTENDS_METHOD": "EXTENDS",
    "EXTENDS_MODEL": "EXTENDS",
    "COMPARED_WITH_METHOD": "COMPARED_WITH",
    "COMPARED_WITH_MODEL": "COMPARED_WITH",
    "EVALUATED_BY_METRIC": "EVALUATED_BY",
    "AUTHORED_BY_AUTHOR": "AUTHORED_BY",
}
STATUSES = ["pending", "success", "partial", "failed"]
DOMAIN_TASKS = ["Knowledge Graph", "NLP", "Computer Vision", "Information Retrieval", "Graph Learning", "Temporal Reasoning", "Link Prediction", "Question Answering", "Text Classification"]

HEADING_PATTERNS = [
    r"^(?:\d+\.)+\s+[A-Z][a-zA-Z\s\-]+$",
    r"^(?:[IVX]+)\.\s+[A-Z][a-zA-Z\s\-]+$",
    r"(?i)^(?:Abstract|摘要)$",
    r"(?i)^(?:Introduction|Related Work|Method(?:ology)?|Experiment|Result|Discussion|Conclusion|References?|Acknowledgments?|Appendix)$",
]
REFERENCES_PATTERN = r"(?i)(?:^|\n)(?:References?|Bibliography)\s*\n"

CHUNK_SIZE, CHUNK_OVERLAP = 800, 100
HEADER_RATIO, FOOTER_RATIO = 0.12, 0.88
TOP_K_CHUNKS = 3
KG_HOPS = 2
COMMUNITY_MIN_SIZE = 3
AUTO_MERGE, REVIEW_LOWER, ROUGH_RATIO, MAX_CANDIDATES = 0.92, 0.75, 0.40, 20
FALLBACK_RATIO = 0.80
LOW_CONFIDENCE, HIGH_CONFIDENCE = 0.70, 0.85
DOCUMENT_CHARS, PREVIEW_CHARS, LIST_PREVIEW_CHARS = 40000, 300, 120
ABSTRACT_CHARS, PARAGRAPH_CHARS = 2000, 1500

#: In order of declaration, which breaks ties; repeated words count twice.
QUESTION_KEYWORDS = {
    "method": ["方法", "method", "approach", "算法", "algorithm", "模型", "model", "提出", "propose", "设计", "design", "实现", "implement", "什么方法", "哪些方法", "how does", "what method"],
    "limitation": ["不足", "局限", "缺点", "缺陷", "limitation", "shortcoming", "drawback", "问题", "problem", "缺陷", "弱点", "weakness", "有什么问题", "有哪些不足", "what are the limitations"],
    "summary": ["摘要", "总结", "概述", "summary", "abstract", "概述", "介绍", "这篇论文", "this paper", "这篇文章", "主要内容", "main contribution"],
    "comparison": ["区别", "比较", "vs", "versus", "difference", "对比", "不同", "比较一下", "compare", "哪种更好", "which is better", "哪个", "哪些", "优劣", "优劣对比", "优缺点"],
    "factual": ["什么是", "什么是", "what is", "定义", "define", "概念", "解释", "explain", "描述", "describe"],
    "statistical": ["多少", "how many", "几篇", "几个", "数量", "count", "统计", "statistics", "一共", "总共有"],
    "graph": ["关联", "相关", "关系", "related", "connected", "linked", "使用哪些", "使用了什么", "哪些实体", "图谱"],
}
TYPE_PRIORITY = {
    "method": ["Method", "Model", "Task", "Paper"],
    "limitation": ["Result", "Dataset", "Method", "Paper"],
    "summary": ["Paper", "Method", "Task", "Domain"],
    "comparison": ["Method", "Result", "Dataset", "Metric", "Paper"],
    "factual": ["Method", "Model", "Task", "Paper", "Domain"],
    "statistical": ["Dataset", "Metric", "Result", "Paper"],
    "graph": ["Paper", "Method", "Dataset", "Model", "Author", "Institution", "Domain"],
    "general": ["Paper", "Method", "Dataset", "Task", "Model", "Author"],
}
SYNONYMS = {
    "方法": ["method", "approach", "algorithm", "model", "technique"],
    "模型": ["model", "architecture", "network", "framework"],
    "数据集": ["dataset", "benchmark", "corpus", "data"],
    "实验": ["experiment", "evaluation", "evaluation", "result"],
    "结果": ["result", "performance", "accuracy", "F1", "BLEU"],
    "提出": ["propose", "introduce", "present", "develop"],
}
STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "and", "or", "not", "what", "which", "how", "when", "where", "who", "why", "does", "do", "this", "that", "these", "those", "have", "has", "been", "can", "will", "would", "could", "should", "may", "论文", "什么", "哪些", "有什么", "怎么", "如何", "的", "了", "是", "吗", "呢", "吧", "这", "那"]
CROSS_PAPER_WORDS = ["对比", "compare", "vs", "区别", "不同论文", "哪些论文", "多论文", "共同点", "分别讲", "三篇论文", "两篇论文"]
EVIDENCE_ORDER = ["Method", "Model", "Dataset", "Metric", "Task", "Paper"]
TYPE_LABELS_ZH = {"Paper": "论文", "Author": "作者", "Institution": "机构", "Method": "方法", "Task": "任务", "Dataset": "数据集", "Model": "模型", "Metric": "评价指标", "Result": "实验结果", "Domain": "领域"}

#: Fixed headings and notices of contexts and answers.
NO_DATA = "（知识图谱为空，暂无任何论文数据。请先上传并处理论文。）"
KNOWN_PAPERS = "以下系统中已处理的论文（但未检索到与问题直接相关的内容）:"
KNOWN_METHODS = "\n已知方法:"
FROM_PAPER = "来自论文: "
GLOBAL_THEMES = "=== 全局研究主题（社区摘要）==="
LOCAL_HITS = "=== 局部检索结果 ==="
GRAPH_CONTEXT = "=== 知识图谱信息 ==="
CHUNK_CONTEXT = "=== 论文原文片段 ==="
ANSWER_FAILED = "抱歉，生成回答时出错："
STATISTICS_WORDS = ("统计", "实体", "关系")
