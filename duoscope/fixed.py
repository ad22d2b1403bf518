"""Fixed values and defaults that results depend on."""

# The genre names of the public MovieLens 20M item file.
GENRES = [
    "(no genres listed)", "Action", "Adventure", "Animation", "Children", "Comedy", "Crime",
    "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "IMAX", "Musical", "Mystery",
    "Romance", "Sci-Fi", "Thriller", "War", "Western",
]

# Header lines of the public MovieLens 20M files.
ITEMS_HEADER = "movieId,title,genres"
TAG_NAMES_HEADER = "tagId,tag"
RATINGS_HEADER = "userId,movieId,rating,timestamp"
TAGS_HEADER = "movieId,tagId,relevance"

# Rating bound and year range of the item names.
POSITIVE_RATING = 4.0
MIN_YEAR, MAX_YEAR = 1891, 2015

# Defaults of the tree search.
MAX_BINS = 10
NUM_CANDIDATES = 5
MIN_SPLIT_ENTROPY = 0.0
MAX_LEVEL = 5

# Defaults of the learner.
SUBSPACE_DIMENSION = 10
REGULARISATION = 1.0
LEARNING_RATE_START = 1.0
LEARNING_RATE_SPEED = 0.01
MINIBATCH_SIZE = 100
MAX_ITERATIONS = 20
LAMBDA = 1.0
GRID_K = (10, 50, 100, 200)
GRID_REG = (0.1, 1.0, 10.0)
GRID_L0 = (0.01, 0.1, 1.0)
GRID_SPEED = (0.001, 0.01, 0.1)

# Defaults of clustering and popularity.
NUM_CLUSTERS = 100
CLUSTER_ITERATIONS = 40
MIN_RATINGS = 5000

# Entropies equal to this many decimals are ties, so that the last bit of a logarithm
# never decides between two splits.
TIE_DIGITS = 12
