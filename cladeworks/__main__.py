"""python -m cladeworks"""

from .cli import main

main()
