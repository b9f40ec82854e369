"""A synthetic corpus of structured documents, one per customer, as SQL that Spark and DuckDB both run."""

from __future__ import annotations


def _pick(items: str, index: str) -> str:
    n = len(items.split(","))
    return f"split_part('{items}', ',', cast(1 + ({index}) % {n} as int))"


_VERBS = "Led,Designed,Worked on,Reduced,Memimpin,Helped,Built,Participated in,Automated,Responsible for,Meningkatkan,Launched"
_THINGS = "a platform of microservices,the product roadmap,a data pipeline with Spark,the payment backend,user research for growth,machine learning models,a dashboard in Tableau,the mobile app"
_SKILLS = "Python,amazon web services,AWS,k8s,Docker,PostgreSQL,postgres,React,team player,Java / Scala,PHP - Advanced,SQL,Tools: Git,fast learner,Spark,Kafka,Node.js,problem solving,TypeScript,Figma,Jira,passionate,Go,Redis"
_TITLES = "Senior Software Engineer,Data Scientist,Product Manager"


def _statement(i: int) -> str:
    mark = "case k % 4 when 0 then '- ' when 1 then '• ' when 2 then '1. ' else '' end"
    metric = f"case when (k + {i}) % 3 = 0 then ' by ' || cast((k + {i}) % 60 as string) || '%' else '' end"
    return f"case when {i} <= 3 + k % 4 then {mark} || {_pick(_VERBS, f'k * 7 + {i} * 5')} || ' ' || {_pick(_THINGS, f'k + {i} * 3')} || {metric} || '.' || case when k % 4 = 3 then ' ' else chr(10) end else '' end"


CORPUS = f"""
select k as doc_id, c_name || chr(10)
 || case when k % 11 <> 0 then case when k % 37 = 0 then 'hotmama' else 'user' end || cast(k as string) || '@mail.example.com' else 'no mail' end
 || case when k % 3 = 0 then ' | 0812-3456-' || lpad(cast(k % 10000 as string), 4, '0') when k % 5 = 0 then ' | +62 812 3456 ' || lpad(cast(k % 10000 as string), 4, '0') else '' end
 || case when k % 4 = 0 then ' | linkedin.com/in/u' || cast(k as string) else '' end || case when k % 9 = 0 then ' | github.com/u' || cast(k as string) else '' end || chr(10)
 || case when k % 13 = 0 then 'Jl. Sudirman ' || cast(k % 90 as string) || ', Jakarta' || chr(10) else '' end
 || case when k % 17 = 0 then 'DOB: 12/05/' || cast(1970 + k % 30 as string) || chr(10) else '' end
 || case when k % 31 = 0 then '' else case k % 6 when 0 then 'Summary' when 1 then 'Ringkasan' when 2 then 'Profile' when 3 then 'ABOUT ME' else 'Professional Summary' end || chr(10) end
 || {_pick(_TITLES, 'k')} || case when k % 7 <> 0 then ' with ' || cast(k % 15 + 1 as string) || ' years of experience' else '' end || ' who builds reliable services for large teams'
 || repeat(' and keeps systems running for customers in many regions', cast(case when k % 29 = 0 then 0 else k % 15 end as int)) || '.' || chr(10)
 || case when k % 2 = 0 then 'Work Experience' else 'Pengalaman Kerja' end || chr(10)
 || {' || '.join(_statement(i) for i in range(1, 7))} || chr(10)
 || repeat('We met every week to plan the next steps together with partners. ', cast(k % 40 as int)) || chr(10)
 || case when k % 19 = 0 then '' when k % 23 = 0 then 'Skills' || chr(10) || 'Education' || chr(10) else 'Skills' || chr(10) end || {" || ".join(f"case when {i} <= 3 + k % 9 then {_pick(_SKILLS, f'k * 5 + {i} * 7')} || ', ' else '' end" for i in range(1, 12))} || 'SQL' || chr(10)
 || case when k % 4 = 1 then 'Projects' || chr(10) || '- Built a chat bot used by ' || cast(k as string) || ' users' || chr(10) || '- Wrote notes about the design' || chr(10) else '' end
 || 'Education' || chr(10) || case k % 3 when 0 then 'Bachelor of Computer Science' when 1 then 'Sarjana Teknik' else 'High school' end
 || case when k % 2 = 0 then ', Institut Teknologi Bandung' else '' end || case when k % 5 <> 0 then ', ' || cast(2005 + k % 15 as string) else '' end
 || case when k % 29 = 0 then chr(10) || 'Engineer who has built and run large payment systems for many banks' || chr(10) || 'and who now wants to lead a small team that cares about quality' else '' end as text
from (select c_custkey as k, c_name from customer) c
"""

JDS = f"""
select k as jd_id, {_pick(_TITLES, 'k')} || chr(10) || 'At least ' || cast(k % 9 as string) || ' years in the field.' || chr(10)
 || case when k % 6 <> 0 then 'Requirements' || chr(10) else '' end || 'We use ' || {_pick('python and spark,docker and kafka,sql and tableau,react and node.js', 'k')} || ', ' || {_pick('redis,postgresql,aws,java', 'k * 3')} || ' and sql. Strong sql.' || chr(10)
 || case when k % 2 = 0 then 'Nice to have' || chr(10) || {_pick('kubernetes,figma and docker,kafka,terraform and go', 'k')} || chr(10) else '' end as text
from (select n_nationkey as k from nation) n
"""
