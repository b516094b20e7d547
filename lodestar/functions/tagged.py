"""The small labelled table of the tagger: hand-made queries and remarks, a tag behind each word.

D determiner, J adjective, N noun, V verb, R adverb, P preposition or particle, C conjunction, O pronoun, M number.
"""

TAGGED = """
a/D new/J sensor/N for/P water/N pipes/N
we/O need/V a/D cheap/J sensor/N that/O finds/V leaks/N in/P old/J pipes/N
deep/J learning/N for/P medical/J imaging/N
looking/V for/P experts/N in/P graphene/N batteries/N
how/R can/V we/O reduce/V the/D energy/N use/N of/P large/J buildings/N
efficient/J wireless/J networks/N with/P low/J power/N
the/D robot/N moves/V quickly/R and/C quietly/R through/P narrow/J tunnels/N
novel/J materials/N that/O store/V hydrogen/N safely/R
machine/N learning/N models/N trained/V on/P small/J data/N sets/N
please/R help/V me/O with/P my/D project/N on/P solar/J cells/N
an/D autonomous/J drone/N inspects/V the/D bridge/N every/D week/N
detecting/V cracks/N in/P concrete/N walls/N by/P ultrasound/N
i/O want/V to/P build/V a/D very/R small/J motor/N
image/N segmentation/N using/V neural/J networks/N
our/D company/N makes/V medical/J devices/N and/C software/N
fast/J and/C reliable/J control/N of/P electric/J vehicles/N
who/O works/V on/P quantum/N computing/N and/C cryptography/N
the/D price/N of/P steel/N has/V risen/V by/P ten/M percent/N
is/V there/R a/D method/N to/P clean/V sea/N water/N cheaply/R
low/J cost/N desalination/N of/P brackish/J water/N
flexible/J displays/N made/V from/P organic/J semiconductors/N
they/O are/V developing/V a/D smart/J grid/N for/P remote/J villages/N
natural/J language/N processing/N for/P legal/J documents/N
high/J temperature/N superconductors/N and/C their/D uses/N
can/V you/O recommend/V someone/O who/O knows/V fluid/N dynamics/N
optimal/J routing/N of/P delivery/N trucks/N in/P crowded/J cities/N
the/D old/J pump/N often/R fails/V when/R it/O is/V cold/J
monitoring/N of/P air/N quality/N with/P cheap/J sensors/N
biodegradable/J plastics/N from/P food/N waste/N
a/D camera/N that/O sees/V heat/N and/C motion/N
this/D paper/N describes/V three/M simple/J algorithms/N
speech/N recognition/N in/P noisy/J rooms/N
we/O measured/V the/D strength/N of/P several/J light/J alloys/N
additive/J manufacturing/N of/P metal/N parts/N
what/O is/V the/D best/J way/N to/P cool/V a/D server/N room/N
safe/J storage/N of/P nuclear/J waste/N
my/D students/N study/V protein/N folding/N
tiny/J robots/N swim/V in/P blood/N vessels/N
optical/J fibres/N carry/V data/N over/P long/J distances/N
a/D strong/J and/C light/J composite/N for/P aircraft/N wings/N
blockchain/N systems/N for/P supply/N chains/N
early/J detection/N of/P cancer/N cells/N from/P blood/N samples/N
she/O quickly/R designed/V an/D antenna/N for/P small/J satellites/N
real/J time/N traffic/N forecasting/N
carbon/N capture/N and/C storage/N in/P deep/J rock/N
it/O should/V run/V on/P a/D mobile/J phone/N without/P internet/N
virtual/J reality/N training/N for/P surgeons/N
vibration/N control/N in/P tall/J buildings/N during/P earthquakes/N
some/D batteries/N charge/V slowly/R but/C last/V long/R
recycling/N of/P lithium/N from/P used/J batteries/N
we/O are/V looking/V for/P a/D partner/N with/P strong/J skills/N in/P chemistry/N
automatic/J translation/N of/P technical/J manuals/N
the/D two/M engines/N were/V tested/V under/P high/J pressure/N
thin/J films/N that/O bend/V easily/R
soft/J tissue/N engineering/N with/P stem/N cells/N
which/D groups/N do/V research/N on/P renewable/J energy/N
a/D system/N which/O learns/V from/P user/N feedback/N
precise/J positioning/N indoors/R
smart/J textiles/N measure/V heart/N rate/N
do/V not/R use/V toxic/J solvents/N
improving/V crop/N yields/N with/P satellite/N images/N
security/N of/P connected/J cars/N
"""


def sentences() -> list[list[tuple[str, str]]]:
    return [[tuple(x.rsplit("/", 1)) for x in line.split()] for line in TAGGED.strip().splitlines()]
