"""SQL that reads the texts of the derived tree itself, with patterns of its own, for scanners whose syntax allows it."""

from __future__ import annotations

from strataloom.functions.text import glob_regex
from strataloom.plans.corpus import SAMPLES, text_sql
from strataloom.plans.staging import LOOKS


def _files(*endings: str) -> str:
    """WITH f(rel_path, content): the files of the derived tree with these endings, from the supplier table."""
    own = dict.fromkeys((p, t, s.when) for s in SAMPLES for p, t in s.files if p.endswith(endings))
    parts = [f"SELECT {text_sql(p)} AS rel_path, {text_sql(t)} AS content FROM supplier WHERE s_suppkey % {m} = {r}" for p, t, (m, r) in own]
    return "WITH f AS (" + " UNION ALL ".join(parts) + "), lines AS (SELECT rel_path, unnest(string_split(content, chr(10))) AS line FROM f)"


#: By the end of a path: what is no code in such files.
_NO_CODE = {
    ("java", "cs", "go", "proto"): r"""`[^`]*`|"(\\.|[^"\\\n])*"|''(\\.|[^''\\\n])*''|//[^\n]*|/\*([^*]|\*[^/])*\*/""",
    ("js", "ts"): r"""= /[^/*\n][^\n]*/;|`[^`]*`|"(\\.|[^"\\\n])*"|''(\\.|[^''\\\n])*''|//[^\n]*|/\*([^*]|\*[^/])*\*/""",
    ("py", "graphql", "gql"): r""""{3}[^"]*"{3}|"(\\.|[^"\\\n])*"|''(\\.|[^''\\\n])*''|#[^\n]*""",
}


def runs_sql() -> str:
    """SQL for the runs of all scanners over the derived tree: rn, a row a scanner; broken, a row for each broken file.

    A file of code is broken if, texts and comments aside, its brackets do not add up.
    """
    parts, torn = [], []
    bare = " ".join(f"WHEN regexp_matches(rel_path, '\\.({'|'.join(ends)})$') THEN regexp_replace(content, '{no_code}', '', 'g')" for ends, no_code in _NO_CODE.items())
    differ = " OR ".join(f"len(replace(bare, '{a}', '')) <> len(replace(bare, '{z}', ''))" for a, z in ("()", "[]", "{}"))
    marked = f", b AS MATERIALIZED (SELECT *, CASE {bare} ELSE '' END AS bare FROM f), g AS MATERIALIZED (SELECT rel_path, content, {differ} AS uneven FROM b)"
    for i, (globs, words) in LOOKS.items():
        glob = "|".join(glob_regex(g) for g in globs)
        held = " OR ".join(f"contains(content, '{w}')" for w in words) or "true"
        xml, data = i == "maven-dependencies", i in ("npm-dependencies", "avro-schema")
        bad = "NOT contains(content, '</project>')" if xml else "NOT json_valid(content)" if data else "uneven"
        fallback = "contains(content, '<dependency>')" if xml else "false" if data else "true"
        parts.append(
            f"""SELECT '{i}' AS scanner_id, count(*) AS discovered, count(*) FILTER ({held}) AS scanned, count(*) FILTER (({held}) AND NOT {bad}) AS parsed,
  count(*) FILTER (({held}) AND {bad} AND {fallback}) AS fallback, count(*) FILTER (({held}) AND {bad} AND NOT {fallback}) AS failed
  FROM g WHERE regexp_matches(rel_path, '{glob}') HAVING count(*) > 0"""
        )
        kind = "malformed XML" if xml else "malformed JSON" if data else "unbalanced brackets"
        torn.append(f"SELECT rel_path, '{kind}' AS error_type FROM g WHERE regexp_matches(rel_path, '{glob}') AND ({held}) AND {bad}")
    return _files("") + marked + ", rn AS (" + "\nUNION ALL ".join(parts) + "), broken AS (" + " UNION ALL ".join(torn) + ")"


#: A text without its comments.
BARE = r"""regexp_replace(regexp_replace(content, '/\*([^*]|\*[^/])*\*/', '', 'g'), '(^|[^:"])//[^\n]*', '\1', 'g')"""
#: The Java or C# class of a file, with its package or namespace.
OWNER = r"regexp_extract(content, '(?:package|namespace) ([\w.]+)', 1) || '.' || regexp_extract(content, 'class (\w+)', 1)"


def _streams(ending: str, word: str, read: str, write: str, both: str) -> str:
    return rf"""{_files(ending)},
c AS (SELECT {OWNER} AS me, unnest(regexp_extract_all(content, '\.(?:{read}|{write}|{both})(?:<[^>]*>)?\("[^"]+"')) AS call FROM f WHERE contains(content, '{word}')),
k AS (SELECT me, regexp_extract(call, '\.(\w+)', 1) AS op, regexp_extract(call, '"([^"]+)"', 1) AS topic FROM c)
SELECT NULL AS publisher_component_id, me AS subscriber_component_id, topic FROM k WHERE NOT regexp_matches(op, '^(?:{write})$')
UNION ALL SELECT me, NULL, topic FROM k WHERE NOT regexp_matches(op, '^(?:{read})$')"""


def _element(text: str, name: str) -> str:
    return f"nullif(regexp_extract({text}, '<{name}>([^<]*)<', 1), '')"


def _maven() -> str:
    """WITH o: of each pom its own group g, artifact a and version v, its text without parent and plugins, and whether it ends."""
    return rf"""{_files("/pom.xml")},
b AS (SELECT contains(content, '</project>') AS whole, regexp_extract(content, '(?s)<parent>.*</parent>') AS up, regexp_replace(regexp_replace(content, '(?s)<!--.*?-->|<parent>.*</parent>', '', 'g'), '(?s)<plugins>.*</plugins>', '', 'g') AS body FROM f),
c AS (SELECT whole, up, body, regexp_replace(body, '(?s)<dependencies>.*', '') AS own FROM b),
o AS (SELECT whole, body, own, coalesce({_element("own", "groupId")}, {_element("up", "groupId")}) AS g, {_element("own", "artifactId")} AS a, coalesce({_element("own", "version")}, {_element("up", "version")}) AS v FROM c)"""


ORACLES = {
    "scan_gradle_dependencies_dependencies": rf"""{_files("build.gradle")},
m AS (SELECT regexp_extract(rel_path, '([^/]+)/build.gradle$', 1) AS p, regexp_extract(line, '^\s*(\w+)', 1) AS c, regexp_extract_all(line, '[''"]([^''"]+)[''"]', 1) AS q
  FROM lines WHERE regexp_matches(line, '^\s*(implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor)\b')),
n AS (SELECT p, c, CASE WHEN len(q) = 1 THEN string_split(q[1], ':') ELSE q END AS q FROM m)
SELECT p AS source_component_id, q[1] AS group_id, q[2] AS artifact_id, q[3] AS version,
  CASE WHEN c LIKE 'test%' THEN 'test' WHEN c = 'runtimeOnly' THEN 'runtime' WHEN c IN ('compileOnly', 'annotationProcessor') THEN 'provided' ELSE 'compile' END AS scope FROM n""",
    "scan_npm_dependencies_dependencies": f"""{_files("package.json")},
j AS (SELECT content::JSON AS j FROM f WHERE json_valid(content)),
d AS (SELECT j, 'compile' AS scope, unnest(json_keys(j, '$.dependencies')) AS k FROM j
  UNION ALL SELECT j, 'test', unnest(json_keys(j, '$.devDependencies')) FROM j UNION ALL SELECT j, 'provided', unnest(json_keys(j, '$.peerDependencies')) FROM j)
SELECT j->>'$.name' AS source_component_id, CASE WHEN k LIKE '@%' THEN split_part(k, '/', 1) ELSE 'npm' END AS group_id,
  CASE WHEN k LIKE '@%' THEN split_part(k, '/', 2) ELSE k END AS artifact_id,
  coalesce(json_extract_string(j, '/dependencies/' || replace(k, '/', '~1')), json_extract_string(j, '/devDependencies/' || replace(k, '/', '~1')), json_extract_string(j, '/peerDependencies/' || replace(k, '/', '~1'))) AS version, scope FROM d""",
    "scan_go_modules_dependencies": rf"""{_files("go.mod")},
o AS (SELECT rel_path, regexp_extract(line, '^module (\S+)', 1) AS me FROM lines WHERE line LIKE 'module %'),
r AS (SELECT me, regexp_replace(line, '^(require )?\s*', '') AS line FROM lines JOIN o USING (rel_path) WHERE regexp_matches(line, '^(require )?\s*\S+/\S+ v\d')),
s AS (SELECT me, line, split_part(line, ' ', 1) AS p, split_part(line, ' ', 2) AS v FROM r)
SELECT me AS source_component_id, regexp_replace(p, '/[^/]+(/v\d+)?$', '') AS group_id, regexp_extract(p, '([^/]+(?:/v\d+)?)$', 1) AS artifact_id,
  v AS version, 'compile' AS scope, NOT contains(line, '// indirect') AS direct FROM s""",
    "scan_express_api": rf"""{_files(".js", ".ts")},
c AS (SELECT regexp_extract(rel_path, '([^/]+)\.[jt]s$', 1) AS me, unnest(regexp_extract_all({BARE}, '(?:app|router)\.\w+\([''"`][^''"`\\][^''"`]*')) AS call FROM f WHERE contains(content, 'express'))
SELECT me AS component_id, regexp_extract(call, '[''"`](.+)$', 1) AS path, upper(regexp_extract(call, '\.(\w+)', 1)) AS method FROM c""",
    "scan_kafka_streams": _streams(".java", "StreamsBuilder", "stream|table|globalTable", "to", "through"),
    "scan_streamiz_kafka": _streams(".cs", "Streamiz", "Stream|Table|GlobalTable", "To", "Through"),
    "scan_protobuf_schema": rf"""{_files(".proto")},
r AS (SELECT regexp_extract(content, 'package ([\w.]+);', 1) AS me, regexp_extract(content, 'service (\w+)', 1) AS service, unnest(regexp_extract_all(content, 'rpc (\w+)', 1)) AS rpc FROM f)
SELECT me AS component_id, '/' || me || '.' || service || '/' || rpc AS path, 'POST' AS method FROM r""",
    "scan_sql_migration_relationships": rf"""{_files(".sql")},
b AS (SELECT regexp_replace(regexp_replace(regexp_replace(content, '''[^'']*''', '', 'g'), '--[^\n]*', '', 'g'), '/\*[^*]*\*/', '', 'g') AS content FROM f),
t AS (SELECT unnest(string_split(content, ';')) AS t FROM b),
r AS (SELECT regexp_extract(t, 'CREATE TABLE (?:IF NOT EXISTS )?(?:\w+\.)?(\w+)', 1) AS source_id, unnest(regexp_extract_all(t, 'REFERENCES (\w+)', 1)) AS target_id FROM t)
SELECT source_id, target_id, 'DEPENDS_ON' AS type FROM r WHERE source_id <> ''""",
    "scan_celery_tasks": rf"""{_files(".py")},
p AS (SELECT replace(regexp_replace(rel_path, '\.py$', ''), '/', '.') AS me, content FROM f WHERE contains(content, 'celery')),
d AS (SELECT me AS definer, unnest(regexp_extract_all(content, '@[^\n]*task[^\n]*\ndef \w+')) AS d FROM p),
t AS (SELECT definer, regexp_extract(d, 'def (\w+)', 1) AS fn, coalesce(nullif(regexp_extract(d, 'queue=''([^'']+)''', 1), ''), 'celery') AS queue FROM d),
c AS (SELECT me, unnest(regexp_extract_all(content, '\w+\.(?:delay|apply_async)\([^\n]*')) AS c FROM p)
SELECT me AS publisher_component_id, definer AS subscriber_component_id, coalesce(nullif(regexp_extract(c, 'queue=''([^'']+)''', 1), ''), queue) AS topic
FROM c JOIN t ON fn = regexp_extract(c, '^(\w+)', 1)""",
    "scan_dotnet_solution": rf"""{_files(".sln")},
q AS (SELECT rel_path, string_split(line, '"') AS q FROM lines WHERE line LIKE 'Project(%'),
p AS (SELECT DISTINCT ON (rel_path, q[4]) rel_path, q[4] AS name, lower(q[6]) AS path FROM q WHERE q[6] LIKE '%proj')
SELECT substr(sha256('dotnet-project|' || name), 1, 16) AS id, name,
  CASE WHEN regexp_matches(path, 'web|api|mvc') THEN 'SERVICE' WHEN regexp_matches(path, 'test|infra|data|core') THEN 'MODULE' ELSE 'LIBRARY' END AS type FROM p""",
    "scan_flask_rest": rf"""{_files(".py")},
r AS (SELECT replace(regexp_replace(rel_path, '\.py$', ''), '/', '.') AS me, unnest(regexp_extract_all(content, '@\w+\.(?:route|get|post|put|delete|patch)\([^\n]*')) AS r FROM f WHERE regexp_matches(content, 'flask|Flask|Blueprint')),
m AS (SELECT me, r, regexp_extract(r, '\(''([^'']+)', 1) AS path, regexp_extract_all(regexp_extract(r, 'methods=\[([^\]]*)', 1), '\w+') AS ms, regexp_extract(r, '\.(\w+)', 1) AS verb FROM r),
e AS (SELECT me, path, unnest(CASE WHEN verb <> 'route' THEN [upper(verb)] WHEN len(ms) > 0 THEN ms ELSE ['GET'] END) AS method FROM m)
SELECT me AS component_id, path, method, CASE WHEN contains(path, '<') THEN regexp_extract(path, ':(\w+)>', 1) || ': ' || regexp_extract(path, '<(\w+):', 1) END AS request_schema FROM e""",
    "scan_sidekiq_jobs": rf"""{_files(".rb")},
p AS (SELECT coalesce(nullif(regexp_extract(content, 'module (\w+)', 1), '') || '::', '') AS outer_name, unnest(regexp_extract_all(content, 'class [A-Z]\w*(?:[^c]|c[^l]|cl[^a])*')) AS c FROM f),
k AS (SELECT outer_name || regexp_extract(c, 'class (\w+)', 1) AS name, c FROM p),
w AS (SELECT name, coalesce(nullif(regexp_extract(c, 'queue: [:'']([\w-]+)', 1), ''), 'default') AS queue FROM k WHERE contains(c, 'include Sidekiq::')),
u AS (SELECT name AS caller, unnest(regexp_extract_all(c, '([\w:]+)\.(?:set\([^)]*\)\.)?perform_(?:async|in|at)', 1)) AS callee FROM k)
SELECT caller AS publisher_component_id, name AS subscriber_component_id, queue AS topic FROM u JOIN w ON callee = name""",
    "scan_kafka_messaging": rf"""{_files(".java")},
j AS (SELECT {OWNER} AS me, content FROM f WHERE regexp_matches(content, 'KafkaListener|[kK]afkaTemplate|SendTo')),
l AS (SELECT me, unnest(regexp_extract_all(content, '@KafkaListener\([^)]*\)')) AS a FROM j),
o AS (SELECT me, unnest(regexp_extract_all(content, '@SendTo\([^)]*\)')) AS a FROM j),
s AS (SELECT me, unnest(regexp_extract_all(content, '[kK]afkaTemplate\.send\(([^,)]+)', 1)) AS a FROM j)
SELECT NULL AS publisher_component_id, me AS subscriber_component_id, unnest(regexp_extract_all(regexp_extract(a, 'topics = (\{{[^}}]*\}}|"[^"]*")', 1), '"([^"]+)"', 1)) AS topic FROM l
UNION ALL SELECT me, NULL, unnest(regexp_extract_all(a, '"([^"]+)"', 1)) FROM o UNION ALL SELECT me, NULL, replace(a, '"', '') FROM s""",
    "scan_rabbitmq_messaging": rf"""{_files(".java")},
j AS (SELECT {OWNER} AS me, content FROM f WHERE regexp_matches(content, 'RabbitListener|[rR]abbitTemplate'))
SELECT NULL AS publisher_component_id, me AS subscriber_component_id, unnest(regexp_extract_all(content, '@RabbitListener\(queues = "([^"]+)"', 1)) AS topic FROM j
UNION ALL SELECT me, NULL, unnest(regexp_extract_all(content, '[rR]abbitTemplate\.(?:convertAndSend|send)\("([^"]+)"', 1)) FROM j""",
    "scan_grpc_service": rf"""{_files(".java")},
j AS (SELECT {OWNER} AS me, regexp_extract(content, 'extends (\w+)Grpc\.', 1) AS service, unnest(regexp_extract_all(content, 'void \w+\(\w+ \w+, StreamObserver<\w+>')) AS m FROM f WHERE contains(content, 'ImplBase'))
SELECT me AS component_id, '/' || service || '/' || upper(regexp_extract(m, 'void (\w)', 1)) || regexp_extract(m, 'void \w(\w*)', 1) AS path, 'POST' AS method,
  regexp_extract(m, '\((\w+)', 1) AS request_schema, regexp_extract(m, '<(\w+)>', 1) AS response_schema FROM j""",
    "scan_grpc_service_dotnet": rf"""{_files(".cs")},
c AS (SELECT {OWNER} AS me, regexp_extract(content, ': (\w+)\.\w+Base', 1) AS service, unnest(regexp_extract_all(content, 'override Task<\w+> \w+\(\w+')) AS m FROM f)
SELECT me AS component_id, '/' || service || '/' || regexp_extract(m, '> (\w+)', 1) AS path, 'POST' AS method, regexp_extract(m, '\((\w+)', 1) AS request_schema, regexp_extract(m, '<(\w+)>', 1) AS response_schema
FROM c WHERE service <> ''""",
    "scan_grpc_service_go": rf"""{_files(".go")},
g AS (SELECT regexp_extract(content, 'package (\w+)', 1) AS me, regexp_extract(content, 'pb\.Register(\w+)Server', 1) AS service, unnest(regexp_extract_all(content, 'func \(\w+ \*\w+\) \w+\([^)]*\) \([^)]*\)')) AS m FROM f)
SELECT me AS component_id, '/' || service || '/' || regexp_extract(m, '\) (\w+)\(', 1) AS path, 'POST' AS method, regexp_extract(m, 'in \*pb\.(\w+)', 1) AS request_schema, regexp_extract(m, '\(\*pb\.(\w+)', 1) AS response_schema
FROM g WHERE service <> ''""",
    "scan_java_http_client": rf"""{_files(".java")},
j AS (SELECT regexp_extract(content, 'package (\w+)', 1) AS me, content FROM f WHERE regexp_matches(content, 'FeignClient|[rR]estTemplate|[wW]ebClient')),
c AS (SELECT me, unnest(regexp_extract_all(content, '@FeignClient\(name = "([^"]+)"', 1)) AS host, 'Feign' AS technology FROM j
  UNION ALL SELECT me, unnest(regexp_extract_all(content, '[rR]estTemplate\.\w+\("https?://([^/":]+)', 1)), 'RestTemplate' FROM j
  UNION ALL SELECT me, unnest(regexp_extract_all(content, '\.uri\("https?://([^/":]+)', 1)), 'WebClient' FROM j)
SELECT DISTINCT me AS source_id, host AS target_id, 'CALLS' AS type, technology FROM c WHERE NOT contains(host, '.') AND host <> 'localhost'""",
    "scan_faust_streaming": rf"""{_files(".py")},
p AS (SELECT replace(regexp_replace(rel_path, '\.py$', ''), '/', '.') AS me, content FROM f WHERE contains(content, 'faust')),
t AS (SELECT me, unnest(regexp_extract_all(content, '\w+ = app\.topic\(''[^'']+')) AS t FROM p),
v AS (SELECT me, regexp_extract(t, '^(\w+)', 1) AS var, regexp_extract(t, '''(.+)$', 1) AS topic FROM t),
a AS (SELECT me, unnest(regexp_extract_all(content, '\.agent\(\w+\)\s+async def \w+')) AS a FROM p),
s AS (SELECT me, unnest(regexp_extract_all(content, '(\w+)\.send\(', 1)) AS var FROM p)
SELECT NULL AS publisher_component_id, a.me || '.' || regexp_extract(a, 'def (\w+)', 1) AS subscriber_component_id, coalesce(topic, regexp_extract(a, '\((\w+)', 1)) AS topic
FROM a LEFT JOIN v ON v.me = a.me AND var = regexp_extract(a, '\((\w+)', 1)
UNION ALL SELECT s.me, NULL, coalesce(topic, s.var) FROM s LEFT JOIN v ON v.me = s.me AND v.var = s.var""",
    "scan_graphql_schema": rf"""{_files(".graphql", ".gql")},
b AS (SELECT regexp_extract(rel_path, '([^/]+)\.\w+$', 1) AS me, regexp_replace(regexp_replace(content, '"{{3}}[^"]*"{{3}}', '', 'g'), 'extend type (\w+) \{{ (.*) \}}', 'type \1 {{' || chr(10) || '  \2' || chr(10) || '}}', 'g') AS content FROM f),
c AS (SELECT me, chr(10) || unnest(string_split(content, chr(10) || '}}')) AS c FROM b),
q AS (SELECT me, regexp_extract(c, '\ntype (Query|Mutation|Subscription)\b', 1) AS root, c FROM c),
l AS (SELECT me, upper(root) AS root, unnest(string_split(c, chr(10))) AS line FROM q WHERE root <> '')
SELECT me AS component_id, regexp_extract(line, '(\w+)', 1) AS path, root AS method,
  CASE WHEN regexp_matches(line, '^\s+\w+\(') THEN replace(array_to_string(regexp_extract_all(regexp_extract(line, '\((.*)\)', 1), '\w+: \[*[A-Z]\w*[!\]]*'), ', '), '!', '') END AS request_schema,
  replace(CASE WHEN regexp_matches(line, '^\s+\w+\(') THEN regexp_extract(line, '\): (\S+)', 1) ELSE regexp_extract(line, '^\s+\w+: (\S+)', 1) END, '!', '') AS response_schema
FROM l WHERE regexp_matches(line, '^\s+\w')""",
    "scan_mongodb_relationships": rf"""{_files(".java")},
j AS (SELECT {OWNER} AS me, unnest(regexp_extract_all(content, '@DBRef\s+private [^;]+;')) AS d FROM f WHERE contains(content, '@Document'))
SELECT me AS source_id, coalesce(nullif(regexp_extract(d, '<(\w+)>', 1), ''), regexp_extract(d, 'private (\w+)', 1)) AS target_id, 'DEPENDS_ON' AS type FROM j""",
    "scan_jpa_entities_relationships": rf"""{_files(".java")},
j AS (SELECT {OWNER} AS me, unnest(regexp_extract_all(content, '@(?:OneToMany|ManyToOne|OneToOne|ManyToMany)(?:\([^)]*\))?\s+[^;]+;')) AS d FROM f WHERE contains(content, '@Entity'))
SELECT me AS source_id, coalesce(nullif(regexp_extract(d, '<(\w+)>', 1), ''), regexp_extract(d, 'private (\w+)', 1)) AS target_id, 'DEPENDS_ON' AS type FROM j""",
    "scan_django_orm_relationships": rf"""{_files("models.py")},
p AS (SELECT replace(regexp_replace(rel_path, '\.py$', ''), '/', '.') || '.' || regexp_extract(content, 'class (\w+)\(models.Model', 1) AS me,
  unnest(regexp_extract_all(content, 'models\.(?:ForeignKey|OneToOneField|ManyToManyField)\(\s*(?:to=)?''[^'']+')) AS k FROM f WHERE contains(content, 'models.Model'))
SELECT me AS source_id, regexp_extract(k, '(\w+)$', 1) AS target_id, 'DEPENDS_ON' AS type FROM p""",
    "scan_sqlalchemy_entities_relationships": rf"""{_files(".py")},
k AS (SELECT replace(regexp_replace(rel_path, '\.py$', ''), '/', '.') AS mod, unnest(string_split(content, chr(10) || 'class ')) AS k FROM f WHERE contains(content, 'sqlalchemy')),
p AS (SELECT mod || '.' || regexp_extract(k, '^(\w+)', 1) AS me, k FROM k WHERE regexp_matches(k, '^\w+\((?:Base|SQLModel, table=True)\):')),
t AS (SELECT me, unnest(regexp_extract_all(k, '(?:ForeignKey\(|foreign_key=)[''"](\w+)\.', 1)) AS t FROM p)
SELECT me AS source_id, array_to_string(list_transform(string_split(t, '_'), lambda x: upper(x[1]) || x[2:]), '') AS target_id, 'DEPENDS_ON' AS type FROM t
UNION ALL SELECT me, unnest(regexp_extract_all(k, 'relationship\(\s*[''"](\w+)', 1)), 'DEPENDS_ON' FROM p
UNION ALL SELECT me, unnest(regexp_extract_all(k, ': "(\w+)" = Relationship', 1)), 'DEPENDS_ON' FROM p""",
    "scan_go_modules": f"""{_files("go.mod")}
SELECT substr(sha256('go|' || split_part(line, ' ', 2)), 1, 16) AS id, split_part(line, ' ', 2) AS name, 'SERVICE' AS type FROM lines WHERE line LIKE 'module %'""",
    "scan_npm_dependencies": f"""{_files("package.json")}
SELECT substr(sha256('npm|' || (content::JSON->>'$.name')), 1, 16) AS id, content::JSON->>'$.name' AS name, 'SERVICE' AS type FROM f WHERE json_valid(content)""",
    "scan_gradle_dependencies": rf"""{_files("build.gradle")}, p AS (SELECT regexp_extract(rel_path, '([^/]+)/build.gradle$', 1) AS name FROM f)
SELECT substr(sha256('gradle|' || name), 1, 16) AS id, name, 'SERVICE' AS type FROM p""",
    "scan_protobuf_schema_data_entities": rf"""{_files(".proto")},
b AS (SELECT regexp_extract(content, 'package ([\w.]+);', 1) AS me, string_split({BARE}, 'service ')[1] AS content FROM f),
i AS (SELECT me, unnest(regexp_extract_all(content, 'message \w+ \{{[^{{}}\n]*\}}')) AS m FROM b),
o AS (SELECT me, regexp_replace(content, 'message \w+ \{{[^{{}}\n]*\}}', '', 'g') AS m FROM b),
x AS (SELECT me, regexp_extract(m, 'message (\w+)', 1) AS name, regexp_extract_all(m, '(?:(?:repeated|optional|required) )?(?:map<[^>]*>|[\w.]+) \w+ = \d+') AS fs FROM (SELECT * FROM i UNION ALL SELECT * FROM o))
SELECT me AS component_id, name, NULL AS primary_key, array_to_string(list_transform(fs, lambda y: regexp_extract(y, '(\w+) =', 1) || ':' || regexp_extract(y, '(map<[^>]*>|[\w.]+) \w+ =', 1) || ':' || (NOT starts_with(y, 'required'))), ',') AS fields FROM x""",
    "scan_nuget_dependencies": rf"""{_files(".csproj")}, p AS (SELECT regexp_extract(rel_path, '([^/]+)\.csproj$', 1) AS name FROM f)
SELECT substr(sha256('nuget|' || name), 1, 16) AS id, name, 'SERVICE' AS type FROM p""",
    "scan_fastapi_rest": rf"""{_files(".py")},
p AS (SELECT replace(regexp_replace(rel_path, '\.py$', ''), '/', '.') AS me, regexp_replace(content, '#[^\n]*', '', 'g') AS content FROM f WHERE contains(content, 'fastapi')),
d AS (SELECT me, unnest(regexp_extract_all(content, '@\w+\.(?:get|post|put|delete|patch)\(\s*"[^@]*(?:@other[^\n]*\s*)?(?:async )?def \w+\([^\n]*\):')) AS d FROM p),
e AS (SELECT me, regexp_extract(d, '"([^"]*)"', 1) AS path, upper(regexp_extract(d, '\.(\w+)', 1)) AS method, regexp_extract(d, 'def \w+\((.*)\):', 1) AS args FROM d),
a AS (SELECT me, path, method, regexp_extract_all(args, '\w+: \w+') AS a FROM e),
g AS (SELECT me, path, method, a, list_filter(a, lambda x: contains(path, '{{' || regexp_extract(x, '(\w+)', 1) || '}}')) AS inp FROM a),
h AS (SELECT me, path, method, inp, list_filter(a, lambda x: NOT list_contains(inp, x) AND regexp_matches(x, ': (str|int|float|bool)$')) AS q,
  list_filter(a, lambda x: NOT list_contains(inp, x) AND regexp_matches(x, ': [A-Z]\w*$') AND NOT regexp_matches(x, ': Dict')) AS bo FROM g)
SELECT me AS component_id, path, method, nullif(array_to_string(list_filter([CASE WHEN len(inp) > 0 THEN 'Path: ' || array_to_string(inp, ', ') END, CASE WHEN len(q) > 0 THEN 'Query: ' || array_to_string(q, ', ') END,
  CASE WHEN len(bo) > 0 THEN 'Body: ' || array_to_string(bo, ', ') END], lambda x: x IS NOT NULL), '; '), '') AS request_schema FROM h""",
    "scan_jaxrs_api": rf"""{_files(".java")},
j AS (SELECT {OWNER} AS me, content, regexp_extract(content, '@Path\("([^"]*)"\)', 1) AS base, regexp_extract(content, '@Produces\(MediaType\.(\w+)\)', 1) AS made,
  regexp_extract(content, '@Consumes\(([^)]*)\)', 1) AS taken FROM f WHERE contains(content, 'ws.rs')),
m AS (SELECT *, unnest(regexp_extract_all(content, '(?:@Path\("[^"]*"\)\s+)?@(?:GET|POST|PUT|DELETE)\s+(?:@\w+\("[^"]*"\)\s+)*public [^(]+\([^{{]*\{{')) AS m FROM j),
n AS (SELECT *, regexp_extract(m, '@(GET|POST|PUT|DELETE)', 1) AS method, regexp_extract(m, '@Path\("([^"]*)"\)', 1) AS sub, regexp_extract(m, 'public (\S+) \w+\(', 1) AS ret, regexp_extract(m, '@Produces\("([^"]*)"\)', 1) AS own,
  list_transform(regexp_extract_all(m, '@\w+Param\("\w+"\) \w+ \w+'), lambda x: regexp_extract(x, '@(\w+)', 1) || ':' || regexp_extract(x, '(\w+)$', 1) || ':' || regexp_extract(x, '(\w+) \w+$', 1)) AS ps FROM m),
o AS (SELECT *, CASE WHEN own <> '' THEN own WHEN made = 'APPLICATION_JSON' THEN 'application/json' END AS produces FROM n)
SELECT me AS component_id, CASE WHEN sub = '' THEN base ELSE base || '/' || ltrim(sub, '/') END AS path, method,
  coalesce(nullif(array_to_string(ps, ', '), ''), nullif(regexp_replace(taken, '[{{}}"]', '', 'g'), '')) AS request_schema, ret || coalesce(' (' || produces || ')', '') AS response_schema FROM o""",
    "scan_spring_rest_api": rf"""{_files(".java")},
b AS (SELECT {BARE} AS bare FROM f WHERE regexp_matches(content, '@(Rest)?Controller')),
j AS (SELECT regexp_extract(bare, 'package ([\w.]+)', 1) || '.' || regexp_extract(bare, 'class (\w+)', 1) AS me, regexp_extract(bare, '@RequestMapping\((?:path = )?"([^"]*)"\)\s+public class', 1) AS base,
  regexp_replace(string_split(bare, chr(10) || 'class ')[1], 'static class \w+ \{{\n[^\n]*\n', '', 'g') AS c FROM b),
m AS (SELECT me, base, unnest(regexp_extract_all(c, '@\w+Mapping[^\n]*\n(?: +@Pre[^\n]*\n)? +[^\n@][^\n]*\{{')) AS m FROM j UNION ALL SELECT me, base, unnest(regexp_extract_all(c, 'public @ResponseBody @\w+Mapping[^\n]*\{{')) FROM j),
n AS (SELECT me, base, regexp_extract(m, '@(\w+)Mapping', 1) AS verb, regexp_extract(m, 'Mapping\(([^\n]*?)\)(?: Hit|\n)', 1) AS args, CASE WHEN contains(m, chr(10)) THEN string_split(m, chr(10))[-1] ELSE regexp_extract(m, '\) (Hit .*)$', 1) END AS sig FROM m),
o AS (SELECT *, unnest(CASE WHEN args = '' THEN [''] ELSE regexp_extract_all(regexp_extract(args, '^(?:(?:value|path) = )?(\{{[^}}]*\}}|"[^"]*")', 1), '"([^"]*)"', 1) END) AS sub FROM n),
p AS (SELECT *, unnest(CASE WHEN verb <> 'Request' THEN [upper(verb)] ELSE regexp_extract_all(args, 'RequestMethod\.(\w+)', 1) END) AS method,
  list_transform(regexp_extract_all(sig, '@(?:PathVariable|RequestParam|RequestBody|RequestHeader)(?:\([^)]*\))? (?:final )?\w+ \w+'), lambda x: regexp_extract(x, '@(\w+)', 1) || ':' || regexp_extract(x, '(\w+)$', 1) || ':' || regexp_extract(x, '(\w+) \w+$', 1)) AS ps FROM o)
SELECT me AS component_id, CASE WHEN sub = '' THEN base ELSE base || '/' || ltrim(sub, '/') END AS path, method, nullif(array_to_string(ps, ', '), '') AS request_schema,
  regexp_extract(sig, '^ *(?:public )?(.*?) \w+\(', 1) AS response_schema FROM p""",
    "scan_jpa_entities": rf"""{_files(".java")},
b AS (SELECT content, regexp_extract(content, 'package ([\w.]+)', 1) || '.' || regexp_extract(content, 'class (\w+)', 1) AS me, regexp_extract(content, 'class (\w+)', 1) AS cls FROM f WHERE regexp_matches(content, '@Entity|@Document')),
e AS (SELECT me, coalesce(nullif(regexp_extract(content, '@(?:Table\(name|Document\(collection) = "([^"]*)"', 1), ''), lower(regexp_replace(cls, '([a-z])([A-Z])', '\1_\2', 'g'))) AS name,
  string_split(string_split(content, 'class ')[2], chr(10) || 'class ')[1] AS c FROM b),
l AS (SELECT me, name, regexp_extract_all(regexp_replace(c, '\{{[^\n]*return[^\n]*\}}|enum[^\n]*', '', 'g'), '(?:@\w+(?:\([^\n]*\))?\s+)*(?:(?:public|private|protected|static|final) )*[\w<>]+(?:\[\])? \w+(?:, \w+)*(?: = [^\n]*)?;') AS ls FROM e),
x AS (SELECT me, name, list_filter(ls, lambda y: NOT regexp_matches(y, '@(OneToMany|ManyToOne|OneToOne|ManyToMany)')) AS ls FROM l),
y AS (SELECT me, name, ls, list_transform(ls, lambda y: regexp_extract(regexp_replace(y, ' = [^\n@]*;$', ';'), '([\w<>]+(?:\[\])? \w+(?:, \w+)*);$', 1)) AS ds, list_transform(ls, lambda y: NOT contains(y, 'nullable = false')) AS ns FROM x),
z AS (SELECT me, name, regexp_extract(array_to_string(ls, ' '), '@Id\s+(?:private )?\w+ (\w+)', 1) AS pk, flatten(list_transform(range(1, len(ds) + 1), lambda i: list_transform(string_split(regexp_extract(ds[i], ' (.*)$', 1), ', '),
  lambda n: n || ':' || replace(regexp_extract(ds[i], '^(\S+)', 1), '[]', '') || ':' || ns[i]))) AS fs FROM y)
SELECT me AS component_id, name, pk AS primary_key, array_to_string(fs, ',') AS fields FROM z""",
    "scan_bundler_dependencies": rf"""{_files("/Gemfile")}, p AS (SELECT DISTINCT regexp_extract(rel_path, '([^/]+)/Gemfile$', 1) AS name FROM f)
SELECT substr(sha256('bundler|' || name), 1, 16) AS id, name, 'SERVICE' AS type FROM p""",
    "scan_bundler_dependencies_dependencies": rf"""{_files("/Gemfile", "/Gemfile.lock")},
l AS (SELECT rel_path, regexp_extract(rel_path, '([^/]+)/Gemfile', 1) AS me, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS i FROM f),
k AS (SELECT me, regexp_extract(line, '^    (\S+)', 1) AS gem, regexp_extract(line, '\((.*)\)', 1) AS v FROM l WHERE rel_path LIKE '%.lock' AND regexp_matches(line, '^    \S+ \(')),
d AS (SELECT me, line, i, sum(CASE WHEN regexp_matches(line, '\bdo\s*$') THEN 1 WHEN trim(line) = 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY me ORDER BY i) AS depth FROM l WHERE rel_path NOT LIKE '%.lock'),
g AS (SELECT a.me, a.i, min(z.depth) FILTER (z.depth < a.depth) AS under, min(z.i) FILTER (z.depth < a.depth) AS til FROM d a JOIN d z ON z.me = a.me AND z.i > a.i
  WHERE regexp_matches(a.line, '^\s*group .*:(test|development)') GROUP BY a.me, a.i),
e AS (SELECT me, i, regexp_extract_all(regexp_extract(line, '^\s*gem (.*)$', 1), '''([^'']*)''', 1) AS q FROM d WHERE regexp_matches(line, '^\s*gem '''))
SELECT substr(sha256('bundler|' || e.me), 1, 16) AS source_component_id, 'rubygems' AS group_id, q[1] AS artifact_id, coalesce(v, q[2], '*') AS version,
  CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.me = e.me AND g.i < e.i AND e.i < g.til) THEN 'test' ELSE 'compile' END AS scope
FROM e LEFT JOIN k ON k.me = e.me AND k.gem = q[1]""",
    "scan_avro_schema": rf"""{_files(".avsc", ".avro")},
r AS (SELECT content::JSON AS j FROM f WHERE json_valid(content) AND content::JSON->>'$.type' = 'record'),
x AS (SELECT j, list_transform(CAST(json_extract(j, '$.fields[*].name') AS VARCHAR[]), lambda n: trim(n, '"')) AS ns, json_extract(j, '$.fields[*].type') AS ts FROM r),
y AS (SELECT j, ns, ts, list_transform(ts, lambda t: CASE WHEN json_type(t) = 'ARRAY' THEN CASE WHEN t->>'$[0]' = 'null' THEN t->'$[1]' ELSE t->'$[0]' END ELSE t END) AS us FROM x)
SELECT j->>'$.namespace' AS component_id, j->>'$.name' AS name, NULL AS primary_key, array_to_string(list_transform(range(1, len(ns) + 1), lambda i: ns[i] || ':' ||
  CASE WHEN json_type(us[i]) <> 'OBJECT' THEN trim(us[i]::VARCHAR, '"') WHEN us[i]->>'$.type' = 'array' THEN 'array<' || (us[i]->>'$.items') || '>' WHEN us[i]->>'$.type' = 'map' THEN 'map<' || (us[i]->>'$.values') || '>'
  ELSE coalesce(us[i]->>'$.name', us[i]->>'$.type') END || ':' || (json_type(ts[i]) = 'ARRAY' AND contains(ts[i]::VARCHAR, '"null"'))), ',') AS fields FROM y""",
    "scan_avro_schema_message_flows": rf"""{_files(".avsc", ".avro")},
r AS (SELECT content::JSON AS j FROM f WHERE json_valid(content) AND content::JSON->>'$.type' = 'record')
SELECT j->>'$.namespace' AS publisher_component_id, NULL AS subscriber_component_id, j->>'$.name' AS topic FROM r
WHERE regexp_matches(lower((j->>'$.namespace') || '.' || (j->>'$.name')), 'event|message|command|kafka')""",
    "scan_pip_poetry_dependencies": rf"""{_files("/requirements.txt", "/pyproject.toml")},
p AS (SELECT DISTINCT regexp_extract(rel_path, '([^/]+)/[^/]+$', 1) AS name FROM f WHERE rel_path LIKE '%.txt' OR regexp_matches(content, '(^|\n)\[(tool\.poetry|project)'))
SELECT substr(sha256('python|' || name), 1, 16) AS id, name, 'SERVICE' AS type FROM p""",
    "scan_pip_poetry_dependencies_dependencies": rf"""{_files("/requirements.txt", "/pyproject.toml")},
l AS (SELECT rel_path, regexp_extract(rel_path, '([^/]+)/[^/]+$', 1) AS me, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS i FROM f),
h AS (SELECT *, last_value(nullif(regexp_extract(line, '^\[([^\]]+)\]', 1), '') IGNORE NULLS) OVER (PARTITION BY rel_path ORDER BY i) AS head FROM l),
d AS (SELECT me, regexp_extract(line, '^([A-Za-z][\w.-]*)', 1) AS n, regexp_extract(line, '(?:==|>=|~=|<=|!=|>|<)\s*([^\s,;#]+)', 1) AS v, 'compile' AS scope FROM h
  WHERE rel_path LIKE '%.txt' AND regexp_matches(line, '^[A-Za-z][\w.-]*(\[[^\]]*\])?\s*[=<>~!]')
  UNION ALL SELECT me, regexp_extract(line, '^([\w.-]+)', 1), regexp_replace(regexp_extract(line, '"([^"]*)"', 1), '^[\^~><=]+', ''), CASE WHEN head LIKE '%.group.%' OR head LIKE '%dev-%' THEN 'test' ELSE 'compile' END FROM h
  WHERE rel_path LIKE '%.toml' AND regexp_matches(head, '^tool\.poetry\.(group\.\w+\.|dev-)?dependencies$') AND regexp_matches(line, '^[\w.-]+ = "') AND NOT starts_with(line, 'python '))
SELECT substr(sha256('python|' || me), 1, 16) AS source_component_id, 'pypi' AS group_id, n AS artifact_id, v AS version, scope FROM d""",
    "scan_maven_dependencies": rf"""{_maven()}
SELECT substr(sha256('maven|' || g || '|' || a), 1, 16) AS id, a AS name, CASE WHEN contains(own, '<packaging>war<') THEN 'SERVICE' ELSE 'LIBRARY' END AS type FROM o WHERE whole""",
    "scan_maven_dependencies_dependencies": rf"""{_maven()},
d AS (SELECT o.*, unnest(regexp_extract_all(body, '(?s)<dependency>.*?</dependency>')) AS d FROM o),
e AS (SELECT *, {_element("d", "groupId")} AS dg, {_element("d", "artifactId")} AS da, {_element("d", "version")} AS dv, {_element("d", "scope")} AS ds, regexp_extract(d, '<version>\$\{{([^}}]+)\}}<', 1) AS asked FROM d)
SELECT CASE WHEN whole THEN a ELSE 'unknown' END AS source_component_id, CASE WHEN dg = '${{project.groupId}}' THEN g ELSE dg END AS group_id, da AS artifact_id,
  CASE WHEN asked = 'project.version' THEN v WHEN asked <> '' AND contains(body, '<' || asked || '>') THEN string_split(string_split(body, '<' || asked || '>')[2], '<')[1] ELSE dv END AS version, coalesce(ds, 'compile') AS scope FROM e""",
    "scan_nuget_dependencies_dependencies": rf"""{_files(".csproj")},
r AS (SELECT regexp_extract(rel_path, '([^/]+)\.csproj$', 1) AS me, unnest(regexp_extract_all(content, '<(?:Package)?Reference [^>]*>')) AS r FROM f),
s AS (SELECT me, starts_with(r, '<Package') AS pack, regexp_extract(r, 'Include="([^",]+)', 1) AS name, nullif(regexp_extract(r, 'Version="?=?"?(\d[\w.-]*)', 1), '') AS v FROM r)
SELECT substr(sha256('nuget|' || me), 1, 16) AS source_component_id, 'nuget' AS group_id, name AS artifact_id,
  CASE WHEN pack THEN coalesce(v, '*') ELSE regexp_extract(v, '^(\d+\.\d+\.\d+)', 1) END AS version, 'compile' AS scope FROM s WHERE pack OR NOT regexp_matches(name, '^(System|Microsoft|mscorlib)')""",
    "scan_django_apps": rf"""{_files("/settings.py", "/apps.py", "/__init__.py")},
s AS (SELECT regexp_extract(rel_path, '^([^/]+)/', 1) AS top, unnest(regexp_extract_all(regexp_extract(content, 'INSTALLED_APPS = \[([^\]]*)\]', 1), '''([^'']+)''', 1)) AS app FROM f WHERE rel_path LIKE '%/settings.py'),
a AS (SELECT regexp_extract(rel_path, '^([^/]+)/', 1) AS top, regexp_extract(rel_path, '([^/]+)/[^/]+$', 1) AS app, max(nullif(regexp_extract(content, 'verbose_name = ''([^'']+)''', 1), '')) AS title FROM f WHERE rel_path NOT LIKE '%/settings.py' GROUP BY ALL)
SELECT substr(sha256('django|' || s.app), 1, 16) AS id, coalesce(title, s.app) AS name, CASE WHEN a.app IS NULL THEN 'LIBRARY' ELSE 'MODULE' END AS type
FROM s LEFT JOIN a USING (top, app) WHERE s.app NOT LIKE 'django.%'""",
    "scan_go_struct": rf"""{_files(".go")},
s AS (SELECT regexp_extract(content, 'package (\w+)', 1) AS me, unnest(regexp_extract_all(content, 'type \w+ struct \{{[^}}]*')) AS s FROM f WHERE regexp_matches(content, 'gorm:|db:|gorm\.Model')),
n AS (SELECT me, regexp_extract(s, 'type (\w+)', 1) AS cls, contains(s, 'gorm.Model') AS based, regexp_extract_all(s, '\w+\s+\S+\s+`[^`]*`') AS ls FROM s),
t AS (SELECT *, list_transform(ls, lambda x: regexp_extract(x, '^\w+\s+\*?(\S+)', 1)) AS ts, list_transform(ls, lambda x: coalesce(nullif(regexp_extract(x, '(?:column:|db:")(\w+)', 1), ''),
  lower(regexp_replace(regexp_extract(x, '^(\w+)', 1), '([a-z])([A-Z])', '\1_\2', 'g')))) AS cs FROM n WHERE based OR len(ls) > 0),
u AS (SELECT me, cls, list_concat(CASE WHEN based THEN ['id:INTEGER:false', 'created_at:TIMESTAMP:true', 'updated_at:TIMESTAMP:true', 'deleted_at:TIMESTAMP:true'] ELSE [] END,
  list_transform(range(1, len(ls) + 1), lambda i: cs[i] || ':' || CASE WHEN regexp_matches(ts[i], '^u?int\d*$') THEN 'INTEGER' WHEN ts[i] = 'string' THEN 'VARCHAR' WHEN ts[i] LIKE 'float%' THEN 'FLOAT' WHEN ts[i] = '[]byte' THEN 'BLOB' ELSE ts[i] END
    || ':' || (NOT regexp_matches(ls[i], 'not null|primaryKey')))) AS fs FROM t)
SELECT me AS component_id, lower(regexp_replace(cls, '([a-z])([A-Z])', '\1_\2', 'g')) || 's' AS name, CASE WHEN starts_with(fs[1], 'id:') THEN 'id' END AS primary_key, array_to_string(fs, ',') AS fields FROM u""",
    "scan_spring_components": rf"""{_files(".java")},
j AS (SELECT {OWNER} AS me, regexp_extract(content, 'class (\w+)', 1) AS name, unnest(regexp_extract_all({BARE}, '(?m)^@(?:[^\n]* @)?(Service|Component|Repository|RestController|Controller|Configuration)\b', 1)) AS kind
  FROM f WHERE contains(content, 'org.springframework.stereotype'))
SELECT substr(sha256(me), 1, 16) AS id, name, CASE WHEN kind IN ('Service', 'RestController', 'Controller') THEN 'SERVICE' ELSE 'MODULE' END AS type FROM j""",
    "scan_sql_migration": rf"""{_files(".sql")},
b AS (SELECT regexp_extract(rel_path, '([^/]+)\.sql$', 1) AS me, regexp_replace(regexp_replace(regexp_replace(content, '''[^'']*''', '', 'g'), '--[^\n]*', '', 'g'), '/\*[^*]*\*/', '', 'g') AS content FROM f),
t AS (SELECT me, unnest(string_split(content, ';')) AS t FROM b),
c AS (SELECT me, regexp_extract(t, 'CREATE TABLE (?:IF NOT EXISTS )?(?:\w+\.)?(\w+)', 1) AS name, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '^"?\w+"? \w') AND NOT starts_with(x, 'CREATE')) AS ls
  FROM t WHERE contains(t, 'CREATE TABLE')),
k AS (SELECT me, name, list_filter(ls, lambda x: NOT regexp_matches(x, '^(PRIMARY|FOREIGN|CONSTRAINT|UNIQUE|CHECK)\b')) AS cs,
  coalesce(nullif(regexp_extract(array_to_string(ls, chr(10)), '(?m)^(?:CONSTRAINT \w+ )?PRIMARY KEY \((\w+)', 1), ''), nullif(regexp_extract(array_to_string(ls, chr(10)), '(?m)^(\w+) [^\n]*PRIMARY KEY', 1), '')) AS pk FROM c)
SELECT me AS component_id, name, pk AS primary_key, array_to_string(list_transform(cs, lambda x: regexp_extract(x, '^"?(\w+)', 1) || ':' || regexp_extract(x, '^"?\w+"? (\w+(?:\([^)]*\))?)', 1) || ':' || (NOT regexp_matches(x, 'NOT NULL|PRIMARY KEY'))), ',') AS fields FROM k""",
    "scan_dotnet_kafka_messaging": rf"""{_files(".cs")},
k AS (SELECT regexp_extract(content, 'namespace ([\w.]+)', 1) || '.' AS space, content, regexp_extract_all(content, 'class (\w+)', 1) AS cs, string_split_regex(content, 'class ') AS parts FROM f WHERE contains(content, 'Confluent.Kafka')),
c AS (SELECT unnest(list_transform(range(1, len(cs) + 1), lambda i: {{'me': space || cs[i], 'c': parts[i + 1]}})) AS x FROM k),
h AS (SELECT x.me AS me, unnest(regexp_extract_all(x.c, '(?:Subscribe|\[KafkaConsumer)\("([^"]+)"', 1)) AS topic FROM c),
s AS (SELECT space, cs, unnest(regexp_extract_all(content, '\.Produce(?:Async)?\("([^"]+)"', 1)) AS topic FROM k)
SELECT 'unknown-publisher' AS publisher_component_id, me AS subscriber_component_id, topic FROM h
UNION ALL SELECT space || unnest(cs), 'unknown-subscriber', topic FROM s
UNION ALL SELECT space || unnest(cs), 'unknown-subscriber', 'unknown-topic' FROM k WHERE contains(content, 'IProducer<')""",
    "scan_go_http_router": rf"""{_files(".go").replace("WITH f", "WITH RECURSIVE f")},
s AS (SELECT rel_path, regexp_extract(content, 'package (\w+)', 1) AS me, content FROM f WHERE regexp_matches(content, 'gin-gonic|gorilla/mux|labstack/echo|go-chi')),
g AS (SELECT me, unnest(regexp_extract_all(content, '(?m)^\s*(\w+ := \w+\.Group\([^)]*)\)', 1)) AS g FROM s),
e AS (SELECT me, regexp_extract(g, '^(\w+)', 1) AS var, regexp_extract(g, ':= (\w+)', 1) AS up, regexp_extract(g, '["`]([^"`]*)', 1) AS own FROM g),
w AS (SELECT me, var, own AS path FROM e WHERE NOT EXISTS (SELECT 1 FROM e u WHERE u.me = e.me AND u.var = e.up) UNION ALL SELECT e.me, e.var, w.path || e.own FROM e JOIN w ON w.me = e.me AND w.var = e.up),
r AS (SELECT me, unnest(regexp_extract_all(content, '\w+\.(?:GET|POST|PUT|DELETE|PATCH)\(["`][^"`]+')) AS r FROM s),
m AS (SELECT me, unnest(regexp_extract_all(content, '\w+\.HandleFunc\("[^\n]*')) AS r FROM s)
SELECT r.me AS component_id, coalesce(w.path, '') || regexp_extract(r, '["`](.+)$', 1) AS path, regexp_extract(r, '\.([A-Z]+)\(', 1) AS method FROM r LEFT JOIN w ON w.me = r.me AND w.var = regexp_extract(r, '^(\w+)', 1)
UNION ALL SELECT me, regexp_extract(r, '\("([^"]+)"', 1), unnest(regexp_extract_all(regexp_extract(r, 'Methods\((.*)\)', 1), '\w+')) FROM m""",
    "scan_mongodb": rf"""{_files(".java")},
j AS (SELECT {OWNER} AS me, regexp_extract(content, '@Document\(collection = "([^"]+)"', 1) AS name, regexp_extract_all(content, '(?:@\w+(?:\([^)]*\))?\s+)*private [^;]+;') AS ls FROM f WHERE contains(content, 'data.mongodb')),
k AS (SELECT me, name, list_filter(ls, lambda x: NOT contains(x, '@DBRef')) AS ls FROM j),
n AS (SELECT me, name, ls, list_transform(ls, lambda x: coalesce(nullif(regexp_extract(x, '@Field\("([^"]+)"', 1), ''), regexp_extract(x, '(\w+);', 1))) AS ns FROM k)
SELECT me AS component_id, name, list_filter(ls, lambda x: contains(x, '@Id'))[1].regexp_extract('(\w+);', 1) AS primary_key,
  array_to_string(list_transform(range(1, len(ls) + 1), lambda i: ns[i] || ':' || regexp_extract(ls[i], 'private (\S+)', 1) || ':' || (NOT contains(ls[i], '@NotNull'))), ',') AS fields FROM n""",
    "scan_rails_api": rf"""{_files("_controller.rb")},
n AS (SELECT regexp_extract(content, 'class ([\w:]+)Controller < ', 1) AS name FROM f)
SELECT substr(sha256('rails|' || name), 1, 16) AS id, name || 'Controller' AS name, 'SERVICE' AS type FROM n WHERE name <> ''""",
    "scan_rails_api_api_endpoints": rf"""{_files("_controller.rb")},
c AS (SELECT regexp_extract(content, 'class ([\w:]+)Controller < ', 1) AS name, string_split(string_split_regex(content, '(^|\n)class ')[2], chr(10)) AS ls FROM f),
l AS (SELECT name, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM c WHERE name <> ''),
v AS (SELECT name, line, last_value(nullif(regexp_extract(line, '^\s*(private|protected|public)\s*$', 1), '') IGNORE NULLS) OVER (PARTITION BY name ORDER BY i) AS seen FROM l),
a AS (SELECT name, regexp_extract(line, '^  def (\w+)', 1) AS act, '/' || lower(regexp_replace(replace(name, '::', '/'), '([a-z])([A-Z])', '\1_\2', 'g')) AS base FROM v
  WHERE coalesce(seen, 'public') = 'public' AND regexp_matches(line, '^  def \w'))
SELECT substr(sha256('rails|' || name), 1, 16) AS component_id, CASE WHEN act IN ('index', 'create') THEN base WHEN act IN ('show', 'update', 'destroy') THEN base || '/:id' ELSE base || '/' || act END AS path,
  CASE act WHEN 'create' THEN 'POST' WHEN 'update' THEN 'PUT' WHEN 'destroy' THEN 'DELETE' ELSE 'GET' END AS method FROM a""",
}
