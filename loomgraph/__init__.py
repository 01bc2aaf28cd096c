"""loomgraph: graph-shaped data and positive Datalog on Spark DataFrames."""

from loomgraph.operators.dictionary import TermDictionary
from loomgraph.operators.fixpoint import reason
from loomgraph.operators.store import TripleStore
from loomgraph.plans.ir import Atom, Const, Program, Rule, Var
from loomgraph.plans.parser import parse_program, read_program

__all__ = ["Atom", "Const", "Program", "Rule", "TermDictionary", "TripleStore", "Var", "parse_program", "read_program", "reason"]
