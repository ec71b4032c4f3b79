"""Words ignored by term discovery.

The default is the whole fixed list of the reference: common words, contraction stems, role words
and equal-opportunity boilerplate. Other lists are passed as a parameter: see ``stopwords=`` on the
market operators and ``read_stopwords``.
"""

# Fixed values.
STOPWORDS = tuple("""
a ability able about above across after again against ain all almost along already also although
always am among an and any anyone applicant applicants application applications apply are aren
around as at bachelor back background base be because been before being below benefits best better
between beyond bonus both business but by can candidate candidates cannot client clients color com
come company compensation consideration could couldn customer customers data day days degree
deliver developer development did didn disability discriminate discrimination diverse diversity do
does doesn doing don done down drive during each either else employer employment engineer
engineering engineers enough ensure equal equity equivalent etc even ever every experience
experiences familiarity few first for from further gender get give go going good got had has hasn
have haven having he help her here hers herself him himself hire hiring his how however http https
i identity if in including inclusion inclusive inside insurance into is isn it its itself job jobs
join just keep know knowledge last law least less let like ll looking make makes making many
master may me might more most much must my myself national need needs neither never new next no
none nor not now of off offer often on once one only onto opportunity or orientation origin other
others our ours ourselves out over own paid partner per phd please plus preferred product products
protected put qualifications race range rather re really regardless religion remote required
requirements responsibilities role roles salary same see senior sex sexual she should shouldn
since skills so software solutions some someone something stakeholders status still strong such
support systems team teams technical than that the their theirs them themselves then there these
they thing things this those though three through throughout thus time to together too tools
toward towards two under understanding until up upon us use used using ve very veteran want was
wasn way ways we well were weren what when where whether which while who whom whose why will with
within without won work working would wouldn www year years you your yours yourself yourselves
""".split())
