"""Small code repositories of our own, one for each behaviour, that named queries and tests run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPOSITORIES: dict[str, dict[str, str]] = {
    "basics": {
        "alpha.py": '"""Alpha module."""\nimport os\nimport numpy as np\nfrom pkg.util import helper as h, other\nfrom . import sibling\n\n\ndef plain(a):\n    """Doc."""\n    return {1: a}\n',
        "pkg/util.py": "def helper():\n    return other()\n\n\ndef other():\n    import json\n    return json\n",
        "pkg-a.py": "x = 1\n",
        "broken.py": "def broken(\n    pass\n",
        "empty.py": "",
        "shapes.py": 'class Shape:\n    """A shape."""\n\n    class Inner:\n        def deep(self):\n            return 1\n\n    @property\n    def area(self):\n        return 0\n\n    async def load(self, a: int,\n                   b: int = 2):\n        def local():\n            return os.path\n        return local()\n',
    },
    "rules": {
        "app/models.py": "class User:\n    def save(self):\n        return store(self)\n\n    def touch(self):\n        return self.save()\n\n\nclass UserStore:\n    def find(self):\n        return 1\n\n\nclass Order:\n    def find(self):\n        return 2\n\n    def ship(self):\n        return 3\n",
        "app/tools.py": "def store(x):\n    return x\n\n\ndef twice(x):\n    return twice(x)\n\n\ndef dup():\n    return 1\n",
        "app/more.py": "def dup():\n    return 2\n",
        "app/main.py": (
            "from app.models import UserStore, User as U\nfrom app.tools import store\nimport app.more\n\n\n"
            "def local():\n    return 1\n\n\n"
            "def run(handler):\n    s = UserStore()\n    local()\n    store(1)\n    dup()\n    s.find()\n    U.save()\n    handler()\n    handler.go()\n    (lambda: 1)()()\n    unknown.ship()\n    unknown.find()\n\n\n"
            "class Job:\n    limit = local()\n\n    def go(self):\n        return Job.stop(self)\n\n    def stop(self):\n        if self:\n            t = UserStore()\n        return t.find()\n"
        ),
        "lib/other.py": "def caller(x):\n    return x.find()\n",
    },
    "shop": {
        "app/routes.py": '"""HTTP routes."""\nfrom app.service import OrderService\n\n\ndef create_order_endpoint(request):\n    """Create an order request and write it to the database."""\n    service = OrderService()\n    return service.place_order(request)\n',
        "app/service.py": "from app.repository import OrderRepository\nfrom app.checks import validate_order\n\n\nclass OrderService:\n    def place_order(self, order):\n        validate_order(order)\n        repo = OrderRepository()\n        return repo.save_to_repo(order)\n",
        "app/checks.py": 'def validate_order(order):\n    """Order input is validated here."""\n    if not order:\n        raise ValueError("empty")\n    return True\n',
        "app/repository.py": "from app.database import execute_write\n\n\nclass OrderRepository:\n    def save_to_repo(self, order):\n        return execute_write(order)\n",
        "app/database.py": 'def execute_write(row):\n    """Write a row to the database."""\n    return row\n',
    },
}


def source_files(spark: SparkSession, *repositories: str) -> DataFrame:
    """(repository_id, file, source) of some fixtures, or of all."""
    rows = [(r, f, s) for r in (repositories or REPOSITORIES) for f, s in REPOSITORIES[r].items()]
    return spark.createDataFrame(rows, "repository_id string, file string, source string")
