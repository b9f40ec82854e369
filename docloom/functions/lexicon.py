"""Patterns and word lists that the scores are defined by."""

from __future__ import annotations

# Section headings, tried in this order on a trimmed lower-case line.
HEADINGS: list[tuple[str, str]] = [
    ("Contact", r"^\s*contact(\s+info(rmation)?)?\s*$"),
    ("Contact", r"^\s*personal\s+(info(rmation)?|details)\s*$"),
    ("Summary", r"^\s*(professional\s+)?summary\s*$"),
    ("Summary", r"^\s*profile\s*$"),
    ("Summary", r"^\s*objective\s*$"),
    ("Summary", r"^\s*about(\s+me)?\s*$"),
    ("Experience", r"^\s*(work\s+)?experience\s*$"),
    ("Experience", r"^\s*employment(\s+history)?\s*$"),
    ("Experience", r"^\s*professional\s+experience\s*$"),
    ("Experience", r"^\s*career\s+history\s*$"),
    ("Skills", r"^\s*(technical\s+)?skills\s*$"),
    ("Skills", r"^\s*technologies\s*$"),
    ("Skills", r"^\s*tech(nical)?\s+stack\s*$"),
    ("Education", r"^\s*education(al)?(\s+background)?\s*$"),
    ("Education", r"^\s*academic(\s+background)?\s*$"),
    ("Projects", r"^\s*(side\s+)?projects\s*$"),
    ("Projects", r"^\s*key\s+projects\s*$"),
    ("Certifications", r"^\s*certifications?\s*$"),
    ("Certifications", r"^\s*licenses?(\s+(&|and)\s+certifications?)?\s*$"),
    ("Certifications", r"^\s*certifications?\s+(&|and)\s+licenses?\s*$"),
    ("Links", r"^\s*(social\s+media|links?|profiles?|online\s+presence)\s*$"),
    ("Contact", r"^\s*(kontak|info(rmasi)?\s+kontak|data\s+pribadi)\s*$"),
    ("Contact", r"^\s*(alamat|telepon|email)\s*$"),
    ("Summary", r"^\s*(ringkasan|profil(\s+(saya|profesional))?|tentang\s+(saya|anda))\s*$"),
    ("Summary", r"^\s*(tujuan\s+(karir|karier)|deskripsi\s+diri)\s*$"),
    ("Summary", r"^\s*(rangkuman\s+(diri|saya))\s*$"),
    ("Experience", r"^\s*(pengalaman(\s+(kerja|pekerjaan))?|riwayat\s+(pekerjaan|karir|karier))\s*$"),
    ("Experience", r"^\s*(pekerjaan|profesi)\s*$"),
    ("Skills", r"^\s*(keahlian|keterampilan|kemampuan)(\s+(teknis|inti|utama))?\s*$"),
    ("Skills", r"^\s*(kompentensi|kompetensi)\s*$"),
    ("Skills", r"^\s*(teknologi|stack(\s+teknologi)?)\s*$"),
    ("Education", r"^\s*(pendidikan|riwayat\s+pendidikan|latar\s+belakang\s+pendidikan)\s*$"),
    ("Education", r"^\s*(akademik|edukasi)\s*$"),
    ("Projects", r"^\s*(proyek|project|portofolio|portfolio)\s*$"),
    ("Certifications", r"^\s*(sertifikat|sertifikasi|lisensi)\s*$"),
    ("Links", r"^\s*(tautan|profil\s+online|media\s+sosial|sosial\s+media)\s*$"),
]
SECTIONS = ("Header", "Contact", "Summary", "Experience", "Skills", "Education", "Projects", "Certifications", "Links", "Other")
SCORED = ("Contact", "Summary", "Experience", "Skills", "Education", "Projects", "Length_Formatting")

# Personal data, replaced in this order.
PII = {
    "EMAIL": r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b",
    "PHONE": r"(?:\+62|08)[\s-]?\d{2,4}(?:[\s-]?\d{3,4}){1,3}",
    "LINKEDIN": r"(?:https?://)?(?:www\.)?linkedin\.com/in/[\w-]+",
    "ADDRESS": r"(?:Jl\.?|Jalan|Gedung|Komp(?:leks)?)\s+[A-Za-z0-9][^\n,;]*",
    "DOB": r"(?:\b(?:born|DOB|lahir|tgl lahir)\b)[:\s]+[A-Za-z0-9/\-\. ]{0,40}?\d{4}",
}

# Patterns of the section scores.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(\+?\d[\d\s().-]{7,}\d)"
URL = r"(https?://|www\.)\S+|linkedin\.com/\S+|github\.com/\S+"
#: Lines that open a summary inside a header: a job title with a tail after a colon or dash, and years of experience.
TITLE_LINE = (
    r"^(?:(?:senior|junior|lead|principal|staff|chief)?\s*"
    r"(?:software|full[\s-]?stack|back[\s-]?end|front[\s-]?end|data|machine[\s-]?learning|ml|devops|cloud|site[\s-]?reliability|"
    r"product|project|engineering|qa|test|sdet|security|android|ios|mobile|web|platform|infrastructure|security|network|"
    r"data\s+science|data\s+analyst|data\s+engineer|ux|ui|ux/ui|graphic|technical|it|systems?)\s*"
    r"(?:developer|engineer|scientist|analyst|designer|architect|manager|consultant|specialist|lead|administrator|programmer|"
    r"researcher|officer|associate|intern|coordinator))\s*[:\-]\s*\S.*$"
)
YEARS_LINE = r"\b(\d+\s*\+?\s*(?:years?|yrs?)|\d+\s*tahun)\b"
METRIC = r"(\d+(\.\d+)?\s*%|\$\s*\d|\d+\s*(users|customers|requests|qps|rps|ms|s|x)|team\s+of\s+\d+|over\s+\d+|\d+\s*(years|yrs|months))"
UNPROFESSIONAL = r"(hotmama|sexy|prince|love|player)\d*@"
YEARS = r"\b(\d+)\+?\s*(years?|yrs?|tahun)\b"
YEAR = r"\b(20\d{2}|19\d{2})\b"
DEGREE = r"\b(?:bachelor|master|phd|mba|doctorate|sarjana|magister|b\.?\s?a\.?|b\.?\s?s\.?|m\.?\s?a\.?|m\.?\s?s\.?|ph\.?\s?d\.?)\b"
SKILL_GROUP = r"\b(languages|frameworks|tools|databases|cloud|platforms)\b"
MATCH_YEARS = r"(\d{1,2})\s*\+?\s*(?:years?|yrs?|tahun)"
JD_YEARS = r"(?:at\s+least|minimum|min\.?|\+)?\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?|tahun)"
JD_ROLE = r"\b((?:senior|junior|staff|principal|lead|intern|graduate)?\s*(?:[A-Z][a-z]+\s+){0,3}(?:Engineer|Developer|Architect|Manager|Scientist|Analyst|Designer|Consultant|Specialist|Pengembang|Insinyur|Programer|Manajer|Analis|Arsitek|Ilmuwan|Desainer|Konsultan|Spesialis))"


def _list(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(","))


# Verbs that open a strong or a weak statement.
STRONG_VERBS = _list("""led, architected, shipped, delivered, designed, built, reduced, increased, improved, optimized, scaled,
    launched, created, owned, drove, negotiated, mentored, automated, deployed, migrated, implemented, established,
    streamlined, memimpin, mengarahkan, membangun, merancang, merancang bangun, mengembangkan, mengurangi, meningkatkan,
    mengoptimalkan, mempercepat, meluncurkan, menciptakan, mengotomatiskan, mendeploy, memigrasi, mengimplementasikan,
    mendirikan, menyederhanakan, menyelamatkan, menekan, mencapai, menyelesaikan, mengelola, mengawasi, mengoordinasikan""")
WEAK_VERBS = _list("""responsible for, worked on, helped, assisted, was tasked, duties included, involved in, participated in,
    bertanggung jawab atas, membantu, ikut serta dalam, terlibat dalam, tugasnya adalah, tugas meliputi, mengerjakan,
    bekerja pada, berperan sebagai""")
ROLE_KEYWORDS = _list("""engineer, developer, manager, analyst, architect, scientist, designer, lead, consultant, specialist,
    insinyur, pengembang, programmer, manajer, analis, arsitek, ilmuwan, desainer, konsultan, spesialis, teknisi, ahli,
    kepala, direktur, pemimpin""")
SENIORITY = _list("senior, junior, staff, principal, lead, intern, magang, tamatan, fresh, graduate")
INDONESIAN = _list("""yang, dan, di, dari, untuk, dengan, pada, telah, sudah, tidak, ini, itu, juga, atau, saat, oleh, dalam, atas,
    tahun, bulan, pengalaman, pekerjaan, keahlian, pendidikan, keterampilan, saya, kami, bertanggung, memimpin, membangun,
    meningkatkan, pengembangan, membantu, magang, sarjana, diploma, teknik, informatika, sistem, teknologi, jaringan,
    basis, data""")
VAGUE = _list("""hard worker, team player, problem solving, problem-solving, self motivated, self-motivated, fast learner,
    passionate, detail oriented, detail-oriented, good communication""")

# Words that a job description's skills are found by.
TECH = _list("""python, go, golang, rust, typescript, javascript, java, kotlin, swift, ruby, php, scala, c++, c#, sql, bash, r,
    matlab, perl, elixir, haskell, clojure, fastapi, flask, django, gin, express, react, vue, angular, next.js, nextjs,
    svelte, rails, spring, springboot, node.js, nodejs, .net, laravel, spark, hadoop, kafka, airflow, dbt, snowflake,
    databricks, redshift, bigquery, pandas, numpy, pytorch, tensorflow, scikit-learn, sklearn, llm, rag, mlops, aws, gcp,
    azure, kubernetes, k8s, docker, terraform, ansible, jenkins, github actions, gitlab ci, argocd, helm, prometheus,
    grafana, elk, elasticsearch, opentelemetry, postgresql, postgres, mysql, mongodb, redis, cassandra, dynamodb, sqlite,
    oracle, mariadb, neo4j, rest, graphql, grpc, websocket, rabbitmq, ios, android, react native, flutter, engineer,
    developer, architect, manager, lead, principal, senior, junior, staff, intern, consultant, analyst, scientist,
    designer, specialist""")

# Signals of a role.
SIGNALS = {
    "swe": _list("""python, java, golang, rust, c++, typescript, javascript, kotlin, swift, ruby, php, scala, elixir, objective-c,
        react, vue, angular, node.js, django, flask, fastapi, spring, rails, laravel, express, nestjs, gin, kubernetes,
        docker, terraform, ansible, helm, jenkins, github actions, ci/cd, microservices, rest api, graphql, grpc, kafka,
        rabbitmq, redis, memcached, git, github, gitlab, bitbucket, backend, frontend, full-stack, fullstack, devops, sre,
        platform, infrastructure, embedded, mobile, ios, android, web developer, software engineer, software developer,
        engineering manager, tech lead, staff engineer, principal engineer, agile, scrum, tdd, bdd, code review"""),
    "data": _list("""python, r, sql, scala, julia, sas, pandas, numpy, scipy, scikit-learn, sklearn, pytorch, tensorflow, keras,
        xgboost, lightgbm, matplotlib, seaborn, plotly, streamlit, spark, hadoop, hive, presto, trino, airflow, dagster,
        dbt, snowflake, bigquery, redshift, databricks, kafka, flink, beam, dataflow, machine learning, deep learning,
        neural network, nlp, computer vision, reinforcement learning, statistics, statistical modeling, a/b testing,
        experiment design, bayesian, time series, forecasting, tableau, looker, power bi, metabase, superset, amplitude,
        mixpanel, segment, data scientist, data analyst, data engineer, analytics engineer, ml engineer,
        machine learning engineer, bi analyst, business intelligence, research scientist, quantitative, kaggle, jupyter,
        notebook, colab"""),
    "pm": _list("""product manager, product owner, product lead, head of product, vp product, vp of product, cpo, chief product,
        program manager, technical product manager, tpm, growth product manager, platform product manager, roadmap,
        product strategy, go-to-market, gtm, product-market fit, user research, user interviews, stakeholder,
        cross-functional, prd, mrd, okrs, kpis, north star, product vision, arr, mrr, nps, ltv, cac, retention, dau, mau,
        wau, conversion, funnel, activation, cohort, engagement, monetization, figma, miro, notion, jira, asana, trello,
        productboard, amplitude, mixpanel, heap, pendo, optimizely, launchdarkly, b2b, b2c, saas, marketplace, fintech,
        edtech, healthtech, 0 to 1, 0-to-1, 1 to 10, 10 to 100, launched, shipped, drove growth, increased engagement"""),
}
DISAMBIGUATORS = {
    "pm": _list("""product manager, product owner, head of product, vp product, vp of product, cpo, chief product, program manager,
        okrs, north star, go-to-market, gtm, roadmap, user research, prd, mrd"""),
    "data": _list("""data scientist, data analyst, data engineer, analytics engineer, ml engineer, machine learning engineer,
        research scientist, bi analyst, business intelligence, kaggle, tableau, looker, power bi, snowflake, bigquery,
        redshift, dbt"""),
    "swe": _list("""software engineer, software developer, full-stack, fullstack, backend, frontend, devops, sre, site reliability,
        kubernetes, terraform, microservices, rest api, graphql, grpc, tech lead, staff engineer, principal engineer"""),
}

# Canonical skills by category, and aliases.
SKILLS = {
    "Language": _list("Python, JavaScript, TypeScript, Java, Go, Rust, C++, C#, Ruby, PHP, Swift, Kotlin, Scala, R, Bash, SQL, HTML, CSS"),
    "Framework": _list("""React, Angular, Vue.js, Next.js, Node.js, Django, Flask, FastAPI, Spring Boot, Express.js, Rails, .NET,
        Laravel, CodeIgniter, Symfony, TensorFlow, PyTorch, Keras, Scikit-learn, Pandas, NumPy"""),
    "Cloud": _list("AWS, GCP, Azure, Docker, Kubernetes, Terraform, Ansible, Jenkins, GitHub Actions, CircleCI, Helm, Istio"),
    "Database": _list("PostgreSQL, MySQL, MongoDB, Redis, Elasticsearch, DynamoDB, BigQuery, Snowflake, SQLite, Oracle, Cassandra"),
    "Data": _list("Spark, Hadoop, Kafka, Airflow, dbt, Tableau, Power BI, Looker, Metabase, Jupyter"),
    "Tool": _list("Git, GitHub, GitLab, Jira, Confluence, Slack, Notion, Figma"),
    "Search": _list("Google, Elastic"),
}
ALIASES = {
    "AWS": _list("amazon web services, amazonaws, amazon aws, aws lambda"),
    "GCP": _list("google cloud, google cloud platform"),
    "Azure": _list("microsoft azure"),
    "Kubernetes": _list("k8s, kube, kubernetes engine, gke, eks, aks"),
    "Python": _list("py, python3, python2"),
    "JavaScript": _list("js, javascript"),
    "Node.js": _list("node, nodejs, node js"),
    "TypeScript": _list("ts, typescript"),
    "Go": _list("golang"),
    "C++": _list("c plus plus, cpp"),
    "C#": _list("c-sharp, c sharp"),
    ".NET": _list("dotnet, .net"),
    "React": _list("react.js, reactjs"),
    "Vue.js": _list("vue, vuejs"),
    "Next.js": _list("next, nextjs"),
    "Express.js": _list("express, expressjs"),
    "Spring Boot": _list("spring, springboot"),
    "TensorFlow": _list("tf, tensorflow"),
    "PyTorch": _list("pytorch, torch"),
    "Scikit-learn": _list("sklearn, scikit learn, scikitlearn"),
    "PostgreSQL": _list("postgres, postgresql, psql"),
    "MongoDB": _list("mongo, mongodb"),
    "Elasticsearch": _list("elastic, opensearch"),
    "BigQuery": _list("big query, bigquery, google bigquery"),
    "Spark": _list("apache spark, pyspark"),
    "Kafka": _list("apache kafka"),
    "Airflow": _list("apache airflow"),
    "Power BI": _list("powerbi, power bi"),
    "GitHub": _list("gh"),
    "GitHub Actions": _list("github actions, gha"),
}


def skill_lookup() -> dict[str, str]:
    """Lower-case name or alias to canonical skill; a canonical name wins over an alias."""
    out = {alias: skill for skill, aliases in ALIASES.items() for alias in aliases}
    return out | {s.lower(): s for skills in SKILLS.values() for s in skills}


# Rubric rules by role as (id, category, weight).
RUBRICS = {
    "general": [("R1", "Contact", 1.0), ("R2", "Contact", 0.7), ("R3", "Summary", 1.5), ("R4", "Experience", 2.0), ("R5", "Experience", 2.5), ("R6", "Experience", 1.0), ("R7", "Skills", 1.5), ("R8", "Skills", 0.7), ("R9", "Education", 0.7), ("R10", "Length_Formatting", 1.0)],
    "swe": [("S1", "Contact", 1.2), ("S2", "Summary", 2.0), ("S3", "Experience", 2.2), ("S4", "Experience", 2.5), ("S5", "Experience", 1.5), ("S6", "Skills", 1.8), ("S7", "Skills", 1.2), ("S8", "Projects", 1.0), ("S9", "Education", 0.7), ("S10", "Length_Formatting", 1.0)],
    "data": [("D1", "Contact", 1.0), ("D2", "Summary", 1.5), ("D3", "Experience", 2.0), ("D4", "Experience", 2.8), ("D5", "Experience", 1.5), ("D6", "Skills", 1.8), ("D7", "Skills", 1.5), ("D8", "Projects", 1.0), ("D9", "Education", 1.2), ("D10", "Length_Formatting", 1.0)],
    "pm": [("P1", "Contact", 1.0), ("P2", "Summary", 1.8), ("P3", "Experience", 2.5), ("P4", "Experience", 2.7), ("P5", "Experience", 1.8), ("P6", "Experience", 1.2), ("P7", "Skills", 1.8), ("P8", "Education", 1.0), ("P9", "Projects", 1.2), ("P10", "Length_Formatting", 1.0)],
}
PRESETS = {"v1 · current (general)": "general", "v1 · swe-tuned": "swe", "v1 · data-tuned": "data", "v1 · pm-tuned": "pm"}
