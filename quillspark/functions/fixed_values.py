"""Word lists and look-up tables that results depend on.

They must hold exactly these values for the same results; each is plain text,
one ``key: value`` a line where it is a mapping.
"""

from __future__ import annotations


def _pairs(text: str) -> dict[str, str]:
    return dict(line.strip().split(": ", 1) for line in text.strip().splitlines())


#: authors' names and other tokens dropped before a name is keyed.
NOISE_TOKENS = "u s p linn linne linnaeus michaux willd willdenow lam lamarck carriere n o nat ord br the of and".split()

#: Words never searched in free text.
STOP_WORDS = """
the and for with from that this are not but was has had have been were also more very than all can its will
may after before during about into over such each which their other being gets like side does one two who when
some there then only just much most even well use used often upon many
""".split()

#: Abbreviated to full names.
ABBREVIATIONS = _pairs("""
acon: aconitum
aesc: aesculus
aeth: aethusa
agar: agaricus
all-c: allium cepa
alum: alumina
ambr: ambra
anac: anacardium
ant-c: antimonium crudum
ant-t: antimonium tartaricum
apis: apis mellifica
arg-n: argentum nitricum
arn: arnica montana
ars: arsenicum album
asaf: asafoetida
aur: aurum metallicum
bapt: baptisia tinctoria
bar-c: baryta carbonica
bell: belladonna
berb: berberis vulgaris
bism: bismuthum
bor: borax
bov: bovista
bry: bryonia alba
cact: cactus grandiflorus
calc: calcarea carbonica
calc-p: calcarea phosphorica
camph: camphora
cann-i: cannabis indica
canth: cantharis
caps: capsicum
carb-an: carbo animalis
carb-v: carbo vegetabilis
caust: causticum
cham: chamomilla
chel: chelidonium
chin: china officinalis
cic: cicuta virosa
cina: cina maritima
cocc: cocculus indicus
coff: coffea cruda
colch: colchicum
coloc: colocynthis
con: conium maculatum
croc: crocus sativus
crot-h: crotalus horridus
cupr: cuprum metallicum
dig: digitalis
dros: drosera rotundifolia
dulc: dulcamara
euph: euphrasia
ferr: ferrum metallicum
gels: gelsemium
glon: glonoinum
graph: graphites
guai: guaiacum
ham: hamamelis
hell: helleborus
hep: hepar sulphuris calcareum
hyos: hyoscyamus
hyper: hypericum
ign: ignatia
iod: iodum
ip: ipecacuanha
kali-bi: kali bichromicum
kali-c: kali carbonicum
kali-p: kali phosphoricum
kreos: kreosotum
lach: lachesis
laur: laurocerasus
led: ledum palustre
lyc: lycopodium clavatum
mag-c: magnesia carbonica
mag-p: magnesia phosphorica
merc: mercurius vivus
mez: mezereum
mosch: moschus
mur-ac: muriaticum acidum
nat-c: natrum carbonicum
nat-m: natrum muriaticum
nat-s: natrum sulphuricum
nit-ac: nitricum acidum
nux-m: nux moschata
nux-v: nux vomica
op: opium
petr: petroleum
phos: phosphorus
phyt: phytolacca
plat: platinum metallicum
plb: plumbum metallicum
podo: podophyllum
puls: pulsatilla
rhod: rhododendron
rhus-t: rhus toxicodendron
ruta: ruta graveolens
sabad: sabadilla
sabin: sabina
samb: sambucus nigra
sang: sanguinaria
sec: secale cornutum
sel: selenium
sep: sepia
sil: silicea
spig: spigelia
spong: spongia tosta
stann: stannum metallicum
staph: staphysagria
stram: stramonium
sul: sulphur
sulph: sulphur
sul-ac: sulphuricum acidum
tarent: tarentula hispanica
thuj: thuja occidentalis
ust: ustilago
valer: valeriana
verat: veratrum album
verat-v: veratrum viride
zinc: zincum metallicum
""")

#: Common to Latin names.
COMMON_TO_LATIN = _pairs("""
acai: euterpe oleracea
aloe vera: aloe
asian ginseng: panax ginseng
ashwagandha: withania somnifera
astragalus: astragalus membranaceus
bilberry: vaccinium myrtillus
bitter orange: citrus aurantium
black cohosh: cimicifuga racemosa
blue cohosh: caulophyllum thalictroides
boswellia: boswellia serrata
butterbur: petasites hybridus
cats claw: uncaria tomentosa
cat s claw: uncaria tomentosa
chamomile: matricaria chamomilla
german chamomile: matricaria chamomilla
roman chamomile: anthemis nobilis
chasteberry: vitex agnus-castus
chaste tree: vitex agnus-castus
cinnamon: cinnamomum verum
cranberry: vaccinium macrocarpon
dandelion: taraxacum officinale
devils claw: harpagophytum procumbens
devil s claw: harpagophytum procumbens
echinacea: echinacea purpurea
elderberry: sambucus nigra
european elder: sambucus nigra
ephedra: ephedra sinica
eucalyptus: eucalyptus globulus
european mistletoe: viscum album
evening primrose oil: oenothera biennis
evening primrose: oenothera biennis
fenugreek: trigonella foenum-graecum
feverfew: tanacetum parthenium
flaxseed: linum usitatissimum
garlic: allium sativum
ginger: zingiber officinale
ginkgo: ginkgo biloba
ginseng: panax ginseng
goldenseal: hydrastis canadensis
grape seed extract: vitis vinifera
green tea: camellia sinensis
hawthorn: crataegus
hibiscus: hibiscus sabdariffa
hoodia: hoodia gordonii
hops: humulus lupulus
horehound: marrubium vulgare
horse chestnut: aesculus hippocastanum
kava: piper methysticum
kudzu: pueraria lobata
lavender: lavandula angustifolia
lemon balm: melissa officinalis
licorice root: glycyrrhiza glabra
licorice: glycyrrhiza glabra
marshmallow: althaea officinalis
milk thistle: silybum marianum
mistletoe: viscum album
noni: morinda citrifolia
oregano: origanum vulgare
passionflower: passiflora incarnata
peppermint: mentha piperita
peppermint oil: mentha piperita
pomegranate: punica granatum
raspberry: rubus idaeus
red clover: trifolium pratense
red yeast rice: monascus purpureus
rhodiola: rhodiola rosea
rosemary: rosmarinus officinalis
sage: salvia officinalis
saw palmetto: serenoa repens
soy: glycine max
spearmint: mentha spicata
st johns wort: hypericum perforatum
saint johns wort: hypericum perforatum
stinging nettle: urtica dioica
nettle: urtica dioica
tea tree oil: melaleuca alternifolia
tea tree: melaleuca alternifolia
thunder god vine: tripterygium wilfordii
turmeric: curcuma longa
valerian: valeriana officinalis
wild yam: dioscorea villosa
willow bark: salix alba
wormwood: artemisia absinthium
yarrow: achillea millefolium
yohimbe: pausinystalia johimbe
alfalfa: medicago sativa
anise: pimpinella anisum
arnica: arnica montana
arnica montana: arnica montana
barley: hordeum vulgare
basil: ocimum basilicum
betony: stachys officinalis
blessed thistle: cnicus benedictus
borage: borago officinalis
buckthorn: rhamnus cathartica
buchu: agathosma betulina
calendula: calendula officinalis
caraway: carum carvi
castor: ricinus communis
chaparral: larrea tridentata
chlorella: chlorella vulgaris
coleus: coleus forskohlii
comfrey: symphytum officinale
cordyceps: cordyceps sinensis
coriander: coriandrum sativum
cumin: cuminum cyminum
dill: anethum graveolens
dong quai: angelica sinensis
eleuthero: eleutherococcus senticosus
fennel: foeniculum vulgare
garcinia: garcinia cambogia
garcinia cambogia: garcinia cambogia
geranium: pelargonium
germander: teucrium chamaedrys
goat s rue: galega officinalis
goats rue: galega officinalis
greater celandine: chelidonium majus
guarana: paullinia cupana
gymnema: gymnema sylvestre
horny goat weed: epimedium
horsetail: equisetum arvense
hyssop: hyssopus officinalis
jasmine: jasminum officinale
kelp: laminaria
khat: catha edulis
kratom: mitragyna speciosa
maca: lepidium meyenii
moringa: moringa oleifera
nutmeg: myristica fragrans
papaya: carica papaya
parsley: petroselinum crispum
pennyroyal: mentha pulegium
pennyroyal oil: mentha pulegium
peony: paeonia officinalis
rhubarb: rheum palmatum
senna: senna alexandrina
skullcap: scutellaria lateriflora
slippery elm: ulmus rubra
spirulina: arthrospira platensis
st john s wort: hypericum perforatum
tongkat ali: eurycoma longifolia
tribulus: tribulus terrestris
uva ursi: arctostaphylos uva-ursi
vervain: verbena officinalis
withania: withania somnifera
yerba mate: ilex paraguariensis
yohimbine: pausinystalia johimbe
black seed: nigella sativa
black cumin: nigella sativa
black cumin seed: nigella sativa
bitter melon: momordica charantia
cascara: rhamnus purshiana
""")


def _terms(text: str) -> dict[str, list[str]]:
    return {k: v.split(", ") for k, v in _pairs(text).items()}


#: Choices of a form and the terms searched for them.
KEYWORD_EXPANSIONS = _terms("""
Aching / Dull: aching, dull, pain
Boring / Drilling: boring, drilling
Bruised / Sore: bruised, sore, lame
Burning: burning, burn, heat
Bursting: bursting, fullness
Constricting / Band-like: constricting, constriction, band
Cramping: cramping, cramp, spasm
Crushing / Heavy: crushing, heavy, heaviness, weight
Cutting: cutting, cut
Drawing / Pulling: drawing, pulling, tearing
Gnawing: gnawing
Itching: itching, itch, pruritus
Lancinating / Piercing: lancinating, piercing
Numb / Tingling: numbness, tingling, numb
Pressing: pressing, pressure
Pulsating / Throbbing: pulsating, throbbing, pulsation
Raw / Excoriated: raw, excoriated, soreness
Sharp: sharp, acute
Shooting: shooting, radiating
Splinter-like: splinter
Stitching / Stabbing: stitching, stabbing, stitch
Stinging: stinging, sting
Tearing: tearing, tear
Wandering / Moving: wandering, shifting, moving
Chilly / Cold person - prefers warmth: chilly, cold, warmth, amelioration
Warm / Hot person - prefers cool: warm, hot, cool
Very thirsty - large quantities: thirst, large quantities
Thirsty - small sips frequently: thirst, sips
Thirstless / Low thirst: thirstless
Thirst for ice-cold water: thirst, cold water, ice
Thirst for warm drinks: thirst, warm drinks
Restless: restless, restlessness
Unrefreshing: unrefreshing, sleep
Difficulty falling asleep: insomnia, sleeplessness
Early waking (3-5am): waking, early morning
Sleepless after midnight: sleepless, midnight
Profuse / Excessive: perspiration, profuse, sweat
Cold sweat: cold sweat, perspiration
Night sweats: night sweats, perspiration
""")

#: Places of the body and the terms searched for them.
LOCATION_TERMS = _terms("""
Head - Forehead: forehead, head, frontal
Head - Temples: temples, head, temporal
Head - Vertex (top): vertex, head, top
Head - Occiput (back): occiput, head, occipital
Head - Sides: head, sides
Head - Whole head: head, headache, cephalalgia
Eyes: eyes, vision, ocular
Ears: ears, hearing, tinnitus
Nose: nose, nasal, coryza
Face - Cheeks: face, cheeks
Face - Jaw: face, jaw
Mouth: mouth, oral
Teeth: teeth, dental, toothache
Tongue: tongue
Throat: throat, pharynx, tonsils
Neck - Cervical: neck, cervical
Back - Upper (thoracic): back, thoracic, dorsal
Back - Between scapulae: back, scapulae, between shoulders
Back - Lower (lumbar): back, lumbar, lumbago
Back - Sacral: back, sacrum, sacral
Back - Coccyx: coccyx, tailbone
Chest - General: chest
Chest - Heart region: heart, chest, cardiac, palpitation
Chest - Lungs: lungs, chest, pulmonary
Chest - Breasts: breast, mammary
Abdomen - Upper (epigastric): abdomen, epigastric, stomach
Abdomen - Umbilical: abdomen, umbilical, navel
Abdomen - Lower (hypogastric): abdomen, hypogastric, lower abdomen
Abdomen - Right side: abdomen, right side, liver
Abdomen - Left side: abdomen, left side, spleen
Abdomen - Liver region: liver, hepatic, abdomen
Stomach: stomach, gastric, digestion, nausea
Rectum: rectum, anus, hemorrhoids
Bladder: bladder, urinary, cystitis
Kidneys: kidneys, renal
Urethra: urethra, urinary
Shoulder - Right: shoulder, right
Shoulder - Left: shoulder, left
Elbow: elbow
Wrist: wrist
Hand: hand, hands
Fingers: fingers
Hip: hip
Thigh: thigh
Knee: knee
Ankle: ankle
Foot: foot, feet
Toes: toes
Skin: skin, eruptions, dermatitis
Joints - General: joints, arthritis, rheumatic
Muscles - General: muscles, muscular
Bones: bones, periosteum
Whole body / General: general, weakness, fatigue
""")

#: Parts of words that make a checked item an emotion.
EMOTION_PARTS = "anxiety irritab anger sadness weeping restless apathy fear mood impatien jealous guilt despair sensitiv solitude company excit confus concentrat forgetful suspic obstin".split()
#: Beginnings that make a checked item a fear.
FEAR_STARTS = "Death, Disease, Being alone, Dark, Height, Crowd, Narrow, Thunder, Animal, Insect, Future, Failure, Going insane, Poverty, Robber, Cancer, Heart disease, Needle, Flying, Water, Ghost, Something bad, Losing control, Public".split(", ")
#: Checked items that are desired food.
FOOD_DESIRES = "Salt/salty, Sweets/sugar, Sour/acids, Spicy/hot, Bitter, Fat/rich food, Milk, Cheese, Eggs, Bread, Meat, Fish, Chocolate, Coffee, Tea, Alcohol/wine, Cold drinks, Warm drinks, Ice/ice cream, Fruit, Vegetables, Raw food, Smoked food, Pickles, Oysters, Onions, Garlic, Potatoes, Rice, Butter".split(", ")
#: Checked items that are food aversions, unless desired.
FOOD_AVERSIONS = "Meat, Fat/rich food, Milk, Eggs, Bread, Coffee, Salt, Sweets, Fish, Fruit, Vegetables, Butter, Cheese, Alcohol, Warm food, Cold food, Cooked food, All food".split(", ")


#: The places that the browser profile knows; others go by their words.
BROWSER_LOCATIONS = """
Head - Forehead, Head - Temples, Head - Vertex (top), Head - Occiput (back), Head - Whole head, Eyes, Ears, Nose, Throat,
Neck - Cervical, Back - Upper (thoracic), Back - Lower (lumbar), Back - Sacral, Chest - General, Chest - Heart region,
Abdomen - Upper (epigastric), Abdomen - Liver region, Stomach, Rectum, Bladder, Kidneys, Knee, Shoulder - Right,
Shoulder - Left, Hip, Foot, Skin, Joints - General, Muscles - General, Whole body / General
""".strip().replace("\n", " ").split(", ")

#: Sensation to search terms in the browser profile.
BROWSER_SENSATIONS = _terms("""
Aching / Dull: aching, dull, pain
Bruised / Sore: bruised, sore, lame
Burning: burning, burn, heat
Cramping: cramping, cramp, spasm
Cutting: cutting
Drawing / Pulling: drawing, pulling, tearing
Itching: itching, itch, pruritus
Numb / Tingling: numbness, tingling, numb
Pressing: pressing, pressure
Pulsating / Throbbing: pulsating, throbbing
Sharp: sharp
Shooting: shooting, radiating
Stitching / Stabbing: stitching, stabbing, stitch
Stinging: stinging, sting
Tearing: tearing
""")
