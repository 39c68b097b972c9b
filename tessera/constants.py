"""Fixed values that must be equal for equal results: word lists, keyword ladders, bucket bounds."""

# fixed values: terms kept whole by the tokenizer when they occur as a substring
PRESERVED_TERMS = (
    "kubectl", "k8s", "apiversion", "namespace", "deployment", "pod", "service", "ingress",
    "networkpolicy", "configmap", "secret", "daemonset", "statefulset", "replicaset",
    "horizontalpodautoscaler", "persistentvolumeclaim",
)

# fixed values: query classes in order of precedence, with their substrings
QUERY_CLASSES = (
    ("configuration", ("create", "configure", "setup", "deploy", "install", "yaml", "manifest")),
    ("troubleshooting", ("error", "fail", "not working", "issue", "problem", "debug", "why", "troubleshoot")),
    ("best_practices", ("best practice", "recommendation", "should", "production", "optimize")),
    ("migration", ("migrate", "upgrade", "update", "version", "transition")),
    ("security", ("security", "rbac", "policy", "secure", "permission", "auth")),
    ("exam", ("certif", "exam", "cka", "ckad", "scenario", "compare", "difference between", "what is the")),
    ("networking", ("network", "service", "ingress", "cni", "connectivity")),
)
DEFAULT_CLASS = "general"

# fixed values: path keys and categories, in order
CATEGORIES = (
    ("concept", "concepts"), ("task", "tasks"), ("tutorial", "tutorials"), ("reference", "reference"),
    ("setup", "setup"), ("config", "configuration"), ("admin", "administration"),
)
DOMAIN_CATEGORIES = (
    ("concept", "concepts"), ("task", "tasks"), ("tutorial", "tutorials"), ("reference", "reference"),
    ("setup", "setup"), ("network", "networking"), ("storage", "storage"), ("security", "security"),
    ("workload", "workloads"), ("config", "configuration"), ("admin", "administration"),
)

# fixed values: document types, tested in order; the YAML suffix comes after the tutorial words
TUTORIAL_WORDS = ("tutorial", "walkthrough", "getting started", "quickstart")
REFERENCE_WORDS = ("api reference", "specification", "schema")
GUIDE_WORDS = ("how to", "step-by-step", "instructions")
CONCEPT_WORDS = ("overview", "introduction", "what is", "concepts")

# fixed values: tag terms
TAG_TERMS = (
    "pod", "deployment", "service", "namespace", "configmap", "secret", "ingress", "networkpolicy",
    "daemonset", "statefulset", "replicaset", "job", "cronjob", "pvc", "pv", "storageclass", "rbac",
    "serviceaccount", "cni", "csi", "cri", "kubectl",
)

# fixed values: file suffixes that are loaded
SUFFIXES = (".md", ".markdown", ".txt", ".yaml", ".yml")

# fixed values: histogram bounds
HTTP_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
SEARCH_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)
GENERATION_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0)
ITERATION_BUCKETS = (1.0, 2.0, 3.0)
SCORE_BUCKETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
