"""Term tables of query validation and keyword extraction, as array literals and as a (term, class) frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# These word lists decide which queries are valid and how keywords score.
STOPWORDS = """
a an the this that these those
for with from via through towards toward into onto upon over under between among about after before during without within behind beyond
and or but nor yet so both either neither
is are was were be been being have has had do does did will would could should may might can must shall
it its they their them we our us you your he she his her i my me
to of by as at on in if then than when what which who whom how why where there here
some any all each every no not only also very just more most less least other another such same different like unlike
""".split()

HIGH = """
neural cnn rnn lstm gpt llm transformer bert diffusion generative adversarial gan vae autoencoder
federated reinforcement backpropagation gradient softmax attention embedding tokenization fine-tuning pretrained
contrastive self-supervised semi-supervised unsupervised
fpga asic vlsi cmos sram dram nand nor photonic optoelectronic plasmonic metamaterial
perovskite graphene nanotube nanowire quantum-dot ferroelectric piezoelectric thermoelectric magnetoresistive
microfluidic microelectromechanical nanoelectromechanical
mimo ofdm cdma tdma fdma beamforming precoding 5g 6g lte wifi bluetooth zigbee lorawan
lidar radar sonar ultrasonic terahertz millimeter-wave
cuda opencl tensorrt onnx kubernetes docker hpc mpi openmp simd risc-v arm x86
crispr proteomics genomics metabolomics transcriptomics electrochemical spectroscopy chromatography rheology
geotechnical geophysical seismology hydrology oceanography aerodynamics thermodynamics kinematics tribology
biomechanics bioinformatics microbiome immunotherapy
underwater subsea offshore subsurface subterranean atmospheric tropospheric stratospheric ionospheric
slam kalman bayesian markov monte-carlo ransac convex stochastic heuristic metaheuristic evolutionary
pid mpc lqr svm knn pca svd fft dft
exoskeleton prosthetics haptic holographic stereoscopic
""".split()

FILTERED = """
self based using used use uses novel new approach method technique way manner type kind
study research work paper project development improved enhanced advanced efficient effective
high low fast slow large small big tiny good better best bad worse worst various multiple
""".split()

MEDIUM = """
learning neural deep machine ai artificial intelligence
classification regression clustering prediction inference training validation testing overfitting regularization
network networks algorithm optimization simulation detection recognition segmentation tracking estimation
control feedback adaptive robust real-time
circuit circuits chip processor accelerator gpu cpu memory cache bandwidth latency throughput
sensor sensors actuator transducer mems
wireless antenna signal channel modulation encoding protocol packet routing congestion qos
distributed parallel cloud edge fog serverless computing computer quantum cryptography encryption
robot robotic robotics autonomous drone uav ugv manipulation navigation localization perception planning
energy power battery solar thermal renewable material materials nano polymer composite alloy
carbon graphene ceramic semiconductor superconductor
water wastewater membrane filtration treatment soil structural seismic geotechnical construction
sustainable urban transportation traffic infrastructure
biomedical medical imaging diagnostic therapeutic wearable implant prosthetic biosensor drug
data database visualization interface api modeling analysis processing synthesis characterization
flow heat transfer diffusion reaction kinetics
federated graph knowledge multimodal heterogeneous sparse dense dynamic static hybrid integrated
video image audio speech language text visual spatial temporal spectral acoustic optical
""".split()

CONTEXT = """
system systems model models framework frameworks design architecture platform application applications
method methods approach technique techniques solution solutions tool tools technology technologies
development implementation integration deployment performance efficiency accuracy reliability scalability
hardware software middleware firmware layer stack component module service services
large small high low fast slow efficient effective novel advanced modern intelligent smart automated
enhanced improved optimized scalable flexible portable
""".split()

CONVERSATIONAL = [
    *"hello hi hey greetings howdy hola bonjour".split(),
    *("good morning", "good afternoon", "good evening", "good night", "how are you", "how do you do", "what's up", "whats up", "sup"),
    *"你好 您好 早上好 下午好 晚上好 再见 goodbye bye こんにちは こんばんは おはよう さようなら".split(),
    *("weather", "rain", "sunny", "cloudy", "temperature", "forecast", "climate today"),
    *("what is the weather", "what's the weather", "how is the weather"),
    *("what time", "what date", "what day", "today", "tomorrow", "yesterday", "current time", "current date"),
    *("thank you", "thanks", "please", "sorry", "excuse me", "pardon"),
    *"yes no maybe okay ok sure fine great nice".split(),
    *("who are you", "what are you", "what can you do", "help me", "how does this work", "what is this"),
    *("tell me a joke", "sing a song", "play a game", "fun", "funny"),
    *"hungry food eat drink tired sleep bored".split(),
    *("test", "testing", "just testing", "ignore", "nothing", "random"),
]

CONVERSATIONAL_WORDS = """
is the what how why when where who do does did can could would should
a an it i you me my your we like today now here there this that
""".split()

OFF_TOPIC = """
weather forecast recipe cooking food restaurant movie film music song singer actor celebrity
sports game football basketball soccer tennis travel vacation hotel flight booking reservation
shopping price discount sale buy shop friend family relationship dating love marriage
news politics election president government joke funny laugh humor meme
""".split()

ENGINEERING = [
    *"computer computing software hardware algorithm data".split(),
    *("machine learning", "artificial intelligence", "ai", "ml", "deep learning", "neural network"),
    *"programming database network security cryptography visualization graphics vision nlp robotics".split(),
    *"electrical electronic circuit signal communication wireless antenna rf microwave photonics semiconductor".split(),
    *"vlsi asic fpga embedded sensor iot power mechanical thermal fluid dynamics aerodynamics".split(),
    *"materials manufacturing cad control automation mems nanotechnology biomechanics".split(),
    *"civil structural geotechnical environmental water transportation construction sustainable infrastructure".split(),
    *("biomedical", "bioengineering", "medical device", "biosensor", "imaging", "tissue", "prosthetics", "drug delivery"),
    *"chemistry physics mathematics optimization simulation quantum energy renewable battery solar climate".split(),
]

NOT_ENGINEERING = """
banking finance investment stock trading accounting marketing sales advertising business management hr
campaign branding commerce retail consumer psychology mental disorder therapy counseling psychiatric
law legal litigation contract policy legislation art music painting sculpture literature poetry drama
history philosophy sociology anthropology political economics religion theology sports athletics fitness yoga
cooking culinary fashion beauty entertainment cinema journalism media editorial publishing
""".split()

GENERIC = "optimization analysis system systems design development".split()

COMMON = """
the be to of and a in that have it for not on with he as you do at this
but his by from they we say her she or an will my one all would there their what
so up out if about who get which go me when make can like time no just him know
take people into year your good some could them see other than then now look only come
its over think also back after use two how work first well way even new want because
any these give day most us is are was were
data system design model network learning machine deep neural sensor control robot image signal
power energy material analysis algorithm optimization
""".split()
# End of the fixed values.

#: The engineering list by single words.
DOMAIN = sorted({word for phrase in ENGINEERING for word in phrase.split()})


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def one_of(word: Column, words: list[str]) -> Column:
    return word.isin(words)


def sql_list(words: list[str]) -> str:
    """The words as a DuckDB list, for the queries that are compared with it."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def frame(spark: SparkSession) -> DataFrame:
    """(term, class) of all tables, for joins against long query tables."""
    tables = {"stop": STOPWORDS, "high": HIGH, "filter": FILTERED, "medium": MEDIUM, "context": CONTEXT, "conversational": CONVERSATIONAL, "off_topic": OFF_TOPIC, "engineering": DOMAIN, "not_engineering": NOT_ENGINEERING, "common": COMMON}
    return spark.createDataFrame([(t, k) for k, terms in tables.items() for t in dict.fromkeys(terms)], "term string, class string")
