"""Every operator by name, for ``from lattica.functions import pagerank``."""

from lattica.graph import Graph, karate_club  # noqa: F401
from lattica.operators.centrality import *  # noqa: F403
from lattica.operators.coloring import *  # noqa: F403
from lattica.operators.community import *  # noqa: F403
from lattica.operators.dag import *  # noqa: F403
from lattica.operators.flow import *  # noqa: F403
from lattica.operators.isomorphism import *  # noqa: F403
from lattica.operators.local import *  # noqa: F403
from lattica.operators.paths import *  # noqa: F403
from lattica.operators.similarity import *  # noqa: F403
from lattica.operators.structure import *  # noqa: F403
from lattica.operators.tours import *  # noqa: F403
from lattica.sources.edge_list import from_edge_list  # noqa: F401
